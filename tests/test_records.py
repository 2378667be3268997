"""Both record formats from literal files, in batch and as a stream that is resumed."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from scholarium.sources import records as rec
from scholarium.sources import store
from scholarium.streaming import ingest as ing

CORE = """<records>
<record><header><identifier>oai:arXiv.org:1706.10</identifier></header><metadata><arXiv><id>1706.10</id>
<authors><author><keyname>Li,,</keyname><forenames></forenames></author><author><forenames>X</forenames></author>
<author><keyname>Wu</keyname><suffix>jr</suffix></author></authors><title>One</title><categories>cs.AI cs.LG</categories><msc-class></msc-class></arXiv></metadata></record>
<record><header status="deleted"><identifier>oai:arXiv.org:2</identifier></header></record>
<record><header><identifier>oai:arXiv.org:3</identifier></header></record>
</records>"""
MORE = """<records><record><header><identifier>oai:arXiv.org:1706.10</identifier></header><metadata><arXiv><title>Changed</title>
<authors><author><keyname>Li</keyname></author></authors></arXiv></metadata></record>
<record><header><identifier>oai:arXiv.org:4</identifier></header><metadata><arXiv><title>Four</title>
<authors><author><keyname>Li</keyname></author><author><keyname>Ng</keyname></author></authors></arXiv></metadata></record></records>"""
RAW = """<records><record><header><identifier>oai:arXiv.org:1706.10</identifier></header><metadata><arXivRaw><id>1706.10</id>
<version version="v10"><date>Tue, 2 Jan 2024 00:00:00 GMT</date><size>5kb</size><source_type>I</source_type></version>
<version version="v2"><date>Mon, 1 Jan 2024 00:00:00 GMT</date><size>0kb</size></version>
<version version="vX"><date>x</date></version><version><date>bad</date></version></arXivRaw></metadata></record>
<record><header><identifier>oai:arXiv.org:9</identifier></header><metadata><arXivRaw><version version="v1"><date>Mon, 1 Jan 2024 00:00:00 GMT</date></version></arXivRaw></metadata></record></records>"""


def test_core_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(CORE.replace('status="deleted"', 'status="deleted"'))
    got = rec.read_core_records(spark, str(tmp_path)).collect()
    assert [r["id"] for r in got] == ["1706.10"]
    r = got[0]
    assert [tuple(a) for a in r["authors"]] == [("Li", None, None), ("Wu", None, "jr")]
    assert r["msc_class"] is None and r["categories"] == "cs.AI cs.LG"


def test_version_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RAW)
    r = {x["id"]: x["versions"] for x in rec.read_version_records(spark, str(tmp_path)).collect()}
    assert [(v["version"], v["size"], v["source_type"], v["date"] is None) for v in r["1706.10"]] == [
        (1, None, "D", True), (2, "0kb", "D", False), (10, "5kb", "I", False)
    ]
    assert len(r["9"]) == 1


def test_stream_continues_and_ignores_known_keys(spark, tmp_path):
    src, raw, root, check = (tmp_path / n for n in ("src", "raw", "root", "check"))
    src.mkdir()
    raw.mkdir()
    (src / "a.xml").write_text(CORE)

    def run():
        ing.stream_core_records(spark, str(src), str(root), str(check)).awaitTermination()

    run()
    run()
    assert ing.read_table(spark, str(root), "papers").count() == 1
    (src / "b.xml").write_text(MORE)
    run()
    papers = {r["id"]: r["title"] for r in ing.read_table(spark, str(root), "papers").collect()}
    assert papers == {"1706.10": "One", "4": "Four"}
    authors = {r["keyname"]: r["id"] for r in ing.read_table(spark, str(root), "authors").collect()}
    assert sorted(authors) == ["Li", "Ng", "Wu"] and sorted(authors.values()) == [1, 2, 3]
    assert ing.read_table(spark, str(root), "paper_authors").count() == 4
    (raw / "v.xml").write_text(RAW)
    ing.stream_version_records(spark, str(raw), str(root), str(tmp_path / "check2")).awaitTermination()
    got = ing.read_table(spark, str(root), "paper_versions").select("paper_id", "version").collect()
    assert sorted(tuple(r) for r in got) == [("1706.10", 1), ("1706.10", 2), ("1706.10", 10)]


def _delivery(path, **papers):
    """A version record file; a paper's versions as (number, day, size, source type)."""
    one = "<version version='v%d'><date>Mon, %d Jan 2020 10:00:00 GMT</date><size>%s</size><source_type>%s</source_type></version>"
    records = "".join(
        f"<record><header><identifier>oai:arXiv.org:{k}</identifier></header><metadata><arXivRaw><id>{k}</id>"
        f"{''.join(one % v for v in versions)}</arXivRaw></metadata></record>"
        for k, versions in papers.items()
    )
    path.write_text(f"<records>{records}</records>")


def test_papers_follow_their_versions(spark, tmp_path):
    from scholarium.operators.maintenance import ingest_versions
    from scholarium.operators.tables import without_orphans

    raw, root = tmp_path / "raw", str(tmp_path / "root")
    raw.mkdir()
    names = [c.split(" ") for c in ing.TABLES["papers"].split(", ")]
    papers = spark.range(1, 6).select(
        F.concat(F.lit("p"), "id").alias("id"), *[F.lit(None).cast(t).alias(n) for n, t in names[1:-1]], F.lit(False).alias("withdrawn")
    )
    papers.write.parquet(f"{root}/papers/batch_id=0")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(name=None, **delivered):
        if name:
            _delivery(raw / name, **delivered)
        ing.stream_version_records(spark, str(raw), root, str(tmp_path / "c1")).awaitTermination()
        ing.stream_paper_updates(spark, root, str(tmp_path / "c2")).awaitTermination()
        # The batch operator over all versions stored so far says the same.
        stored = ing.read_table(spark, root, "paper_versions")
        empty = spark.createDataFrame([], stored.schema)
        merged, expected = ingest_versions(stored, papers, empty)
        assert merged.count() == stored.count() == without_orphans(stored, papers, "paper_id", "id").count()
        got = {r["id"]: r for r in ing.current_papers(spark, root).collect()}
        for e in expected.collect():
            assert [got[e["id"]][c] for c in ("created", "updated", "withdrawn")] == [e["created"], e["updated"], e["withdrawn"]]
        return {k: (r["created"] and r["created"].day, r["updated"] and r["updated"].day, r["withdrawn"], r["n_versions"]) for k, r in got.items()}

    d = (1, 6, "5kb", "D")
    first = run("a.xml", p1=[d], p2=[d, (2, 7, "0kb", "D")], p3=[(2, 9, "1kb", "D")], p9=[d])
    assert first == {"p1": (6, 6, False, 1), "p2": (6, 7, True, 2), "p3": (9, 9, False, 1), "p4": (None, None, False, 0), "p5": (None, None, False, 0)}
    second = run("b.xml", p1=[d, (2, 8, "3kb", "I")], p2=[(3, 12, "4kb", "D")], p3=[(1, 3, "0kb", "D")], p4=[(10, 20, "1kb", "D"), (9, 19, "0kb", "I")])
    assert second == {"p1": (6, 8, True, 2), "p2": (6, 12, False, 3), "p3": (3, 9, False, 2), "p4": (19, 20, False, 2), "p5": (None, None, False, 0)}
    touched = spark.read.parquet(f"{root}/paper_updates").groupBy("paper_id").count().collect()
    assert {r["paper_id"]: r["count"] for r in touched} == {"p1": 2, "p2": 2, "p3": 2, "p4": 1, "p9": 1}
    # Nothing new, a repeated file, and a key whose content differs: the first delivery stays.
    assert run() == second
    assert run("c.xml", p1=[d, (2, 8, "3kb", "I")], p2=[(3, 30, "0kb", "I")]) == second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_record_files_are_short_and_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rec, "RECORDS_PER_FILE", 2)
    version = "struct('v1' AS _version, 'Mon, 6 Feb 2017 00:00:00 GMT' AS date, concat(id, 'kb') AS size, 'D' AS source_type)"
    records = spark.range(5).coalesce(1).selectExpr(
        "struct(concat('oai:arXiv.org:', id) AS identifier) AS header", f"struct(struct(concat('', id) AS id, array({version}) AS version) AS arXivRaw) AS metadata"
    )
    path, root = str(tmp_path / "records"), str(tmp_path / "root")
    rec.write_records(records, path)
    files = sorted(p for p in (tmp_path / "records").iterdir() if p.name.startswith("part-"))
    assert [p.name.endswith(".xml.gz") for p in files] == [True] * 3
    assert sorted(gzip.decompress(p.read_bytes()).count(b"<record>") for p in files) == [1, 2, 2]
    wanted = [(str(i), 1, f"{i}kb") for i in range(5)]
    found = rec.version_rows(rec.read_version_records(spark, path))
    assert sorted(tuple(r) for r in found.select("paper_id", "version", "size").collect()) == wanted
    ing.stream_version_records(spark, path, root, str(tmp_path / "check")).awaitTermination()
    stored = spark.read.parquet(f"{root}/paper_versions")
    assert sorted(tuple(r) for r in stored.select("paper_id", "version", "size").collect()) == wanted


def test_snapshot_and_existence(spark, tmp_path):
    from scholarium.schemas import empty_table

    path = str(tmp_path / "snap")
    store.save_snapshot({"authors": empty_table(spark, "authors")}, path)
    back = store.load_snapshot(spark, path, ["authors"])["authors"]
    assert back.columns == ["id", "keyname", "forenames", "suffix"] and back.count() == 0
    assert store.path_exists(spark, f"{path}/authors") and not store.path_exists(spark, f"{path}/none")
    assert not store.table_exists(spark, "no_such_table")


def test_pages_follow_a_key(spark, tmp_path):
    path = str(tmp_path / "pages")
    ids = [i * 3 for i in range(200)]
    df = spark.createDataFrame([(i, f"t{i}") for i in [*ids, None]], "id long, title string")
    store.save_pages(df, path, "id", rows_per_file=20)
    after, seen = None, []
    while True:
        page = [r["id"] for r in store.page_after(spark, path, "id", 45, after).collect()]
        # Files are cut by sampled borders, so they differ in size.
        assert len(store.page_files(spark, path, 45, after)) <= 8
        if not page:
            break
        assert len(page) == min(45, len(ids) - len(seen))
        seen, after = seen + page, page[-1]
    assert seen == ids
    # A key between two stored ones, and an empty store.
    assert [r["id"] for r in store.page_after(spark, path, "id", 2, 100).collect()] == [102, 105]
    store.save_pages(df.limit(0), str(tmp_path / "none"), "id")
    assert store.page_after(spark, str(tmp_path / "none"), "id", 5).count() == 0
