"""Large ids beside nulls, null item ids, short items, bounded samples."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkveil.llm import decontamination, language, secrets, substring_dedup

BIG = 1 << 60
DOCS = "doc_id long, text string, lang string, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG + 1, "eins zwei password=abcdefgh1"), (None, "drei vier"), (BIG + 3, "fünf sechs"), (None, None), (BIG + 3, "")]
    return spark.createDataFrame([(*r, "de", "mine") for r in rows], DOCS).coalesce(1)


def test_ids_stay_whole_beside_nulls(docs):
    want = sorted([BIG + 1, BIG + 3, BIG + 3, -1, -1])
    ids = lambda df: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect())
    assert ids(secrets.scan(docs)) == ids(language.identify(docs)) == ids(substring_dedup.without_repeats(docs)) == want
    assert dict(secrets.scan(docs).dtypes)["doc_id"] == dict(language.identify(docs).dtypes)["doc_id"] == "bigint"
    digest = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.digests(substring_dedup.without_repeats(docs)).where("n_bytes > 0").collect()}
    assert digest[BIG + 1] == hashlib.sha256(b"eins zwei password=abcdefgh1").hexdigest()


def test_empty_tables(docs):
    none = docs.limit(0)
    assert secrets.scan(none).count() == language.identify(none).count() == substring_dedup.without_repeats(none).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 50)
    seen = []
    clusters = language._clusters

    def counted(idf):
        run = clusters(idf)

        def told(group):
            open(path, "a").write(f"{len(group)}\n")
            return run(group)

        return told

    import tempfile

    path = tempfile.mktemp()
    monkeypatch.setattr(language, "_clusters", counted)
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("fr").alias("lang"))
    names, matrix, *_ = language.learn(rows.union(copies))
    seen = [int(x) for x in open(path).read().split()]
    assert "en" in names and len(matrix) == len(names) and max(seen) < 100 and sum(seen) < 120


def test_letters_of_every_plane(spark):
    learned = spark.createDataFrame([(i, "\U00030000\U00030001 \U00030002" * 5, "zh") for i in range(40)], "doc_id long, text string, lang string")
    got = {r["lang_pred"] for r in language.identify(learned).collect()}
    assert got == {"zh"}


def test_items_without_an_id(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "clean words only"), (3, "q " + item.replace("b", "c"))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item.replace("b", "c")), (7, "other " * 12)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontamination.overlaps(docs, bench).collect()) == [(1, None, 20), (3, None, 20)]
    assert [r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()] == [2]


@pytest.mark.parametrize("n", [12, 11, 10, 9])
def test_short_items_tolerate_one_replaced_word(spark, n):
    item = [f"b{i}" for i in range(n)]
    rows = [(k, " ".join(["x y z"] + item[:k] + ["changed"] + item[k + 1 :] + ["u v w"])) for k in range(n)]
    rows += [(100, " ".join(item[: n // 2])), (101, " ".join(item[::2])), (102, " ".join(item[: n - 4] + ["q"] * 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in decontamination.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    # places that no mask leaves out cannot be replaced in the shortest items; halves and starts are no matches
    assert found <= set(range(n)) and {n // 2} <= found if n == 12 else found <= set(range(n)) and found
