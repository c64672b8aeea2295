"""The pipeline's stages against brute force on a small table."""

import collections

import corpus_pipeline
from sigmafold.runtime import materialise


def test_stages(spark, sf):
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs, kept = start, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == start.columns
    text = {r.doc_id: r.text for r in start.collect()}
    first = [r.doc_id for r in kept["language"].collect()]
    assert sorted(first) == sorted(i for i, t in text.items() if any(c.isalpha() for c in t or ""))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = collections.defaultdict(list)
    for i in first:
        groups[lower(text[i])].append(i)
    assert sorted(r.doc_id for r in kept["exact_dedup"].collect()) == sorted(max(g) for g in groups.values())
    near = {r.doc_id for r in kept["near_duplicates"].collect()}

    def shingles(t):
        w = lower(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(text[i]) for i in (max(g) for g in groups.values())}
    for i in sets:
        assert i in near or any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)
    left = sorted(near)
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for k, a in enumerate(left) for b in left[:k])
    mixed = collections.Counter(r.doc_id for r in kept["mixing"].collect())
    assert set(mixed) == near
    pieces = collections.Counter()
    for r in kept["packing"].collect():
        pieces[r.doc_id] += r.length
    size = {r.doc_id: r.doc_tokens for r in kept["packing"].collect()}
    assert all(pieces[i] == n * size[i] for i, n in mixed.items())


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns of the names that stages use themselves."""
    base = " ".join(f"the word {k} and some letters" for k in range(40))
    texts = [None, "", "  ", "12345 !!!", base, base, base.upper(), base + " and more", "x" * 20_000, "der die das und ein", "one", "one"]
    rows = [(k, t, ("en", "de", None)[k % 3], ("hot", "rare", None)[k % 3], None, -k, "c", 0.5, "t", k) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here but words", "en", "hot", None, 1, "c", 0.5, "t", 99)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row int, __lang string, __score double, __text string, uid int"
    path = str(tmp_path / "hard")
    spark.createDataFrame(rows, schema).write.parquet(path)
    docs, counts = spark.read.parquet(path), {}
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "test")
        counts[name] = docs.count()
        assert name == "packing" or docs.columns == start
    assert counts["language"] == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    # Two groups of equal texts after lower-casing, one near copy.
    assert counts["exact_dedup"] == counts["language"] - 3 - 1 and counts["near_duplicates"] == counts["exact_dedup"] - 1
    docs = spark.read.schema(schema).parquet(path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "test")
        assert docs.count() == 0
