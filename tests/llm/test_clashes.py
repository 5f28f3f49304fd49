"""Columns of a user's table that are named like an operator's own come through unchanged."""
from terralith.llm import exact_dedup, mixing, ngram_join, quality

NAMES = ["row_id", "__n", "__id", "__id2", "__s", "__sha", "__sha2", "__own", "row", "copy", "shuffle_key", "__source",
         "__steps", "kept", "component_id", "n_shingles", "a", "b", "set_id", "score", "__score", "ids", "label", "name"]


def with_names(spark, rows):
    data = [(*r, *[100 * i + k for k in range(len(NAMES))]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in NAMES))


def test_own_names_do_not_matter(spark):
    long = " ".join(f"word{i}" for i in range(60))
    df = with_names(spark, [(1, "One text", "x"), (2, "one TEXT", "x"), (3, long, "y"), (4, long + " more", "y"), (4, long, None),
                            (None, None, "x"), (6, "", "y")])
    before = {tuple(r) for r in df.collect()}
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    for out in (exact_dedup.drop_duplicates(df), ngram_join.drop_near_duplicates(df),
                mixing.mixed_rows(df, {"x": 1.0}, default=1.0), quality.keep_good(df, labels)):
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == df.columns and rows and set(rows) <= before
    kept = exact_dedup.drop_duplicates(df)
    assert kept.count() == 4 and ngram_join.drop_near_duplicates(df).count() < df.count()
    drawn = mixing.mix(df.select("doc_id", "source", "row_id"), {"x": 1.0}, default=1.0).select("row_id").collect()
    assert sorted(r.row_id for r in drawn) == sorted(r.row_id for r in mixing.mixed_rows(df, {"x": 1.0}, default=1.0).collect())
