"""Reading, writing, audit, streaming, and the whole job."""

import datetime
import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkveil.plans.job import run
from inkveil.plans.redaction import redact_documents_to
from inkveil.session import shared_folder
from inkveil.sources import audit as A
from inkveil.sources import files as SF
from inkveil.sources.settings import format_list, parse_list, preset_catalog
from inkveil.streaming.stats import batch_stats, first_findings, stream_first_findings, window_stats, write_first_findings
from inkveil.streaming.stream import read_stream, redact_stream, write_stream

DOCS = "doc_id long, text string"


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7\nline")
    assert [r.path[-5:] for r in SF.read_pdf_files(spark, str(tmp_path)).collect()] == ["a.PDF"]
    assert SF.read_texts(spark, str(tmp_path / "c.txt")).first().text == "%PDF-1.7\nline"


def test_assemble(spark):
    items = spark.createDataFrame([(1, 1, i, s) for i, s in enumerate([" a ", "b\n", "c"])], "doc_id long, page_no long, item_no int, str string")
    assert SF.assemble_pages(items.repartition(3)).first().text == "a b c"
    pages = spark.createDataFrame([(1, 2, "y"), (1, 1, " x"), (1, 12, "z")], "doc_id long, page_no long, text string")
    assert SF.assemble_documents(pages).select("text", "page_count").first() == ("x\n\ny\n\nz", 3)
    parts = SF.assemble_documents(pages).collect()
    assert [(r.part_no, r.text, r.page_count) for r in parts] == [(0, "x\n\ny\n\nz", 3)]


def test_copy_never_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], DOCS)
    with pytest.raises(ValueError):
        SF.write_copy(df, str(tmp_path), str(tmp_path) + "/")
    SF.write_copy(df, "in", str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        SF.write_copy(df, "in", str(tmp_path / "out"))


def test_audit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann and ann", ["ANN"]), (2, "x", [])], "doc_id long, text string, targets array<string>")
    assert redact_documents_to(docs, "in", str(tmp_path / "out"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "out")).where("doc_id = 1").first().text == "███ and ███"
    log = spark.read.parquet(str(tmp_path / "audit"))
    assert sorted((r.action, r.n_entities, r.n_redactions) for r in log.collect()) == [
        ("REDACTION_COMPLETE", None, 2), ("REDACTION_START", 1, None)]
    assert "Ann" not in " ".join(r[0] for r in log.select(A.audit_text()).collect())
    (tmp_path / "file").write_text("in the way")
    assert not A.append_audit(log.drop("ts"), str(tmp_path / "file" / "audit"))
    assert A.failure_audit(docs).count() == 2


def test_audit_json(spark):
    logs = spark.createDataFrame([(1, '{"audit_log":[{"action":"DOCUMENT_LOADED","pageCount":5},{"action":"X"}]}'), (2, "{oops")], "id long, doc string")
    assert [(r.id, r.action, r.pageCount) for r in A.parse_audit_log(logs).collect()] == [(1, "DOCUMENT_LOADED", 5), (1, "X", None)]


def test_settings(spark):
    df = spark.createDataFrame([('["a","b"]',), ("[bad",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_list(F.col("s"))).collect()] == [["a", "b"], [], []]
    assert df.select(format_list(F.array(F.lit("a")))).first()[0] == '["a"]'
    assert preset_catalog(spark).count() == 8


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Mail u{i}@x.org now, Account: 1234567{i}") for i in range(20)], DOCS)
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = redact_stream(read_stream(spark, str(tmp_path / "in"), max_files=2), ["bank-statement"])
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    want = redact_stream(docs, ["bank-statement"])
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want.collect())
    assert "@" not in want.first().text


def test_stream_statistics_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 5, 1)
    after = lambda minutes: start + datetime.timedelta(minutes=minutes)
    # a text is found up to three times within an hour, by several sources, and arrives up to half an hour out of order
    texts = [(rng.randint(0, 1200), rng.randint(0, 5), f"{rng.choice('aB')} {i}") for i in range(150)]
    rows = [(after(m + rng.randint(0, 60)), d, rng.choice([t, t.lower(), f" {t} "]), rng.choice(["x", "y", None])) for m, d, t in texts for _ in range(rng.randint(1, 3))]
    rows.sort(key=lambda r: r[0] + datetime.timedelta(minutes=rng.randint(0, 30)))
    schema = "ts timestamp, doc_id long, text string, source string"
    end, late = (after(10_000), 0, "end", "x"), (start, 1, "too late", "x")
    (tmp_path / "in").mkdir()
    for i, part in enumerate([*(rows[k : k + 70] for k in range(0, len(rows), 70)), [end], [late]]):
        path = tmp_path / "in" / f"{i:03}.json"
        path.write_text("".join(json.dumps({"ts": r[0].isoformat(), "doc_id": r[1], "text": r[2], "source": r[3]}) + "\n" for r in part))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    write_first_findings(stream_first_findings(stream), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    first, found = spark.read.parquet(str(tmp_path / "out")), spark.createDataFrame(rows, schema)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(first) == plain(first_findings(found)) and first.count() == 150
    assert plain(window_stats(first)) == plain(batch_stats(found))
    assert sum(r.n_found for r in batch_stats(found).collect()) == 150


def test_shared_folder():
    def session(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value))

    with pytest.raises(ValueError):
        shared_folder(session(None), "x")
    assert shared_folder(session("/shared/"), "x") == "/shared/x"


JOB_PAGES = [(1, 1, "Signed: Ann Lee"), (1, 2, "ANN LEE wrote to bob@x.org"), (2, 1, "nothing here"), (1, 10**7, "ann  lee, 12/25/2023")]
PAGES = "doc_id long, page_no long, text string"


def test_job(spark, tmp_path):
    pages = spark.createDataFrame(JOB_PAGES, PAGES)
    manual = spark.createDataFrame([(1, "wrote"), (1, "wrote")], DOCS)
    out = run(pages, str(tmp_path), "2024-05-01", presets=["legal-document"], manual=manual)
    text = {(r.doc_id, r.page_no): r.text for r in spark.read.parquet(out.redacted).collect()}
    assert text == {(1, 1): "Signed: ███████", (1, 2): "███████ █████ to █████████", (2, 1): "nothing here", (1, 10**7): "ann  lee, ██████████"}
    # one list for the document: "ANN LEE" and "ann  lee" of later pages are "Ann Lee" again; manual entities stand last
    found = spark.read.parquet(out.entities).orderBy("ord").collect()
    assert [r.text for r in found].count("Ann Lee") == 1 and not {"ANN LEE", "ann  lee"} & {r.text for r in found}
    lines = [r.line for r in spark.read.parquet(out.report).where("doc_id = 1").orderBy("line_no").collect()]
    assert lines[:3] == ["Redaction report", "Generated: 2024-05-01", "Document: 1"]
    assert [x.split(". ", 1)[1] for x in lines[4:]] == [r.text for r in found] + ["wrote"]
    log = spark.read.parquet(out.audit).orderBy("ts").collect()
    assert [(r.action, r.n_entities, r.n_redactions) for r in log] == [
        ("REDACTION_START", len(found) + 1, None), ("REDACTION_COMPLETE", None, sum(r.n_redactions for r in spark.read.parquet(out.redacted).collect()))]
    assert tuple(spark.read.parquet(out.stats).first()) == (2, len(found) + 1, len(found) + 1)


def test_job_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    from inkveil.plans import job

    pages = spark.createDataFrame(JOB_PAGES, PAGES)
    again = lambda **more: run(pages.repartition(3), str(tmp_path), "2024-05-01", **more)
    scans = []
    scan = job.scan
    monkeypatch.setattr(job, "scan", lambda *a, **k: scans.append(1) or scan(*a, **k))

    def broken(pages, targets):
        raise RuntimeError("no disk")

    with monkeypatch.context() as m:
        m.setattr(job, "redact_pages", broken)
        with pytest.raises(RuntimeError):
            again()
    log = lambda: sorted(r.action for r in spark.read.parquet(str(tmp_path / "audit")).collect())
    assert log() == ["REDACTION_ERROR", "REDACTION_START"] and len(scans) == 1
    first = again()
    assert len(scans) == 1  # the entities were stored
    assert log() == ["REDACTION_COMPLETE", "REDACTION_ERROR", "REDACTION_START"]
    assert again() == first and len(log()) == 3
    other = again(presets=["identity"])  # another job does not take these stages
    assert len(scans) == 2 and other.entities != first.entities


def test_job_takes_out_by_place(spark, tmp_path):
    pages = spark.createDataFrame([(1, p, " ".join(f"u{i}@x{p}.org" for i in range(2000))) for p in (1, 10**7)], PAGES)
    out = run(pages, str(tmp_path / "a"), "2024-05-01")
    found = spark.read.parquet(out.entities)
    assert found.count() == 4000 == found.select("doc_id", "ord").distinct().count()
    gone = found.where("text = 'u7@x1.org'").select("doc_id", "ord")
    out = run(pages, str(tmp_path / "b"), "2024-05-01", removed=gone)
    kept = spark.read.parquet(out.redacted).orderBy("page_no").collect()
    assert [r.n_redactions for r in kept] == [1999, 2000] and "u7@x1.org" in kept[0].text and "@" not in kept[1].text


def test_copy_guard_resolves_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], DOCS)
    df.write.parquet(str(tmp_path / "in"))
    back = spark.read.parquet(str(tmp_path / "in"))
    for source in (back, f"file://{tmp_path}/in/", f"file:{tmp_path}/in"):
        with pytest.raises(ValueError):
            SF.write_copy(df, source, f"{tmp_path}/in")
    with pytest.raises(ValueError):
        SF.write_copy(df, back, f"file://{tmp_path}")
    SF.write_copy(df, back, f"{tmp_path}/out")
