"""Every operator on hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigmafold.llm import exact_dedup, fingerprints, html_blocks, html_extract, language_id, lm_scoring, mixing, near_duplicates, packing, quality, token_ids, token_output
from sigmafold.runtime import materialise, scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, uid bigint, label int, state string"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hard_rows():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " ", "\n\n", "one", "One", "ONE", base, base, base.upper(), " ".join(near), words(rng, 40_000), "über Straße\nçédille – “quotes”",
        "a\tb  c \n d", "12345 !!!", "x" * 50_000, base, "zero \x00 byte", "end \n",
        "a <|endoftext|> b<|startoftext|>c, <|endoftext|>!",
    ]
    rows = [(i, t, ("en", "de", "fr", None)[i % 4], ("hot", "hot", "rare", None)[i % 4], None) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a row that repeats
    rows.append((None, "no id", "en", "hot", 1))
    return [(*r, 0.5, "clash", 7, 1, "s") for r in rows]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "docs")
    spark.createDataFrame(hard_rows(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def rows_by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


# --- op1 ---


def test_language(spark, hard, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"), 4, 2)))
    found = language_id.identify(docs, model, [F.col("doc_id"), F.col("lang")]).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    got = rows_by_id(language_id.identify(hard, model, [F.col("doc_id")]))
    for i in (0, 1, 2, 3, 14):
        assert got[i][0].lang_pred == "und" and got[i][0].score == 0
    assert got[7][0] == got[7][1] and sum(map(len, got.values())) == len(hard_rows())
    assert language_id.identify(empty, model, [F.col("doc_id")]).count() == 0


def test_language_without_labels(hard, empty):
    model = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(hard, model, [F.col("doc_id")]).collect()} == {"und"}


def test_margins_do_not_depend_on_windows(monkeypatch):
    texts = language_id.letters(pa.array(["abc def", "x", "häß lich ganz", "q" * 99]))
    w = [np.random.default_rng(k).standard_normal(len(language_id.SIZES) * language_id.BUCKETS).astype(np.float32) for k in range(2)]
    whole = language_id.margins(texts, w, np.zeros(2))
    monkeypatch.setattr(language_id, "_WINDOW", 7)
    assert np.allclose(whole, language_id.margins(texts, w, np.zeros(2)), atol=1e-5)
    for i, t in enumerate(texts.to_pylist()):
        places, values = language_id.example(t.encode())
        assert np.allclose(whole[i], [values @ x[places] for x in w], atol=1e-3)


# --- op2 ---


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train()


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    "<header>Site</header><div class='ad'>Buy anenon erest.</div><article><h1>Anon erin</h1><p><b>Erest &amp;  anin\n on.<br><p>Onre thin &lt;ing&gt; er.</p><ul><li>Item onerre</li></ul></article>"
    "<section id='comments'><div class='comment'><p>Reply nanon eri.</p></div></section><form><label>Search</label><button>Go</button></form><footer>&copy; x</footer></body></html>"
)


def test_extraction(labeller, spark):
    assert html_extract.extract([PAGE], labeller) == ["Anon erin\nErest & anin on.\nOnre thin <ing> er.\nItem onerre"]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <a href='"), (5, "x", "plain"), (6, "y", "<" * 3000), (7, "z", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_extract.extract_text(df, labeller).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert html_extract.extract_text(df.limit(0), labeller).count() == 0


def test_labels_of_unseen_pages(labeller):
    rng = np.random.default_rng(77)
    data = [d for d in (html_extract.training_page(rng) for _ in range(150)) if len(d[0])]
    found = np.concatenate(labeller.label([d[0] for d in data]))
    assert (found == (np.concatenate([d[1] for d in data]) > 0)).mean() > 0.97


def test_long_pages_are_labelled_in_parts(labeller, monkeypatch):
    page = [(("div", "p", f"c{k % 5}"), f"word {k} of a block that is not short, {k % 7}", k % 3) for k in range(300)]
    whole = labeller.label([page])[0]
    for size in (7, 100):
        monkeypatch.setattr(html_extract, "BATCH_BLOCKS", size)
        assert (labeller.label([page])[0] == whole).all()


def test_gradient_of_the_network():
    model = html_extract.BlockLabeller(1)
    model.weights = [w.astype(np.float64) for w in model.weights]
    rng = np.random.default_rng(0)
    x, y = rng.random((4, 3, html_extract.FEATURES)), (rng.random((4, 3)) > 0.5).astype(float)
    mask = np.ones((4, 3))
    mask[3, 1] = 0

    def loss():
        z, _ = model.logits(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = model.step(x, mask, y)
    for k in (1, 4, 6):
        at = (2, 0) if k < 6 else (3, 0)
        model.weights[k][at] += 1e-3
        up = loss()
        model.weights[k][at] -= 2e-3
        down = loss()
        model.weights[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-3


def test_blocks_of_odd_markup():
    assert [t for _, t, _ in html_blocks.blocks("<p>a<p>b<!-- <p>no --><script>x</script>c<br>d<td>e")] == ["a", "b c d", "e"]
    assert html_blocks.blocks("") == []


def test_paths_hold_all_names_at_any_depth():
    (path, *_), *_ = html_blocks.blocks('<div class="mt-4 flex flex-col gap-2 p-4 rounded border shadow" id="comments">x')
    assert ".comments" in path
    found = {t: p for p, t, _ in html_blocks.blocks("<div id='outer'>" + "<i>" * 300 + "<div id='sidebar'>x</div><p>y</p>")}
    assert ".sidebar" in found["x"] and ".outer" in found["y"] and ".sidebar" not in found["y"]
    deep = html_blocks.blocks("".join(f"<div id='{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>t" for k in range(15_000)))
    assert len(deep) == 15_000 and all(len(p) <= html_blocks.PATH_BUCKETS + 1 for p, *_ in deep)


# --- op3 ---


@pytest.mark.parametrize("target", [mixing.Target(max_repeats=2.0), mixing.Target(entropy=1.0), mixing.Target(), mixing.Target(max_repeats=1.5, budget=100_000)])
def test_mixing(hard, target):
    got = mixing.mix(hard, target, block_tokens=4096).collect()
    cost = {i: len(re.findall(r"\S+", t or "")) + 1 for i, t, *_ in hard_rows()}
    tokens = collections.Counter()
    for i, _, _, source, *_ in hard_rows():
        tokens[source or ""] += cost[i]
    placed, weight = collections.Counter(), {}
    for r in got:
        placed[r.source or ""] += r.n_tokens
        weight[r.source or ""] = r.weight
        assert r.n_tokens == cost[r.doc_id]
    assert abs(sum(weight.values()) - 1) < 1e-5
    if target.budget is None:
        assert {r.doc_id for r in got} == set(cost)
    if target.max_repeats == 2.0:
        assert max(placed[s] / tokens[s] for s in tokens) <= 2.0 + 1e-9
    if target.entropy:
        assert abs(-sum(w * math.log(w) for w in weight.values()) - 1.0) < 1e-3
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.block].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing_is_repeatable_and_empty(hard, empty):
    one, two = (sorted(map(tuple, mixing.mix(hard.repartition(n), mixing.Target(max_repeats=2.0)).select("doc_id", "pass_no", "block").collect()), key=str) for n in (1, 5))
    assert one == two
    assert mixing.mix(empty, mixing.Target(max_repeats=2.0)).count() == 0
    assert mixing.mix_rows(hard, mixing.Target(max_repeats=1.25)).columns == hard.columns


def test_mixed_rows_lie_in_blocks(spark, hard):
    target = mixing.Target(max_repeats=1.25)
    want = [r.doc_id for r in sorted(mixing.mix(hard, target, block_tokens=4096).collect(), key=lambda r: (r.block, r.slot))]
    path = scratch_path(spark, "mixed")
    mixing.mix_rows(hard, target, block_tokens=4096).write.parquet(path)
    rows = spark.read.parquet(path).select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.f, r.k))] == want


# --- op4 ---


def test_scores_against_brute_force(spark, hard, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(hard.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000))
    learn = ~language_id.held_out(F.col("doc_id"), 7, 2)
    got = rows_by_id(lm_scoring.score(docs, learn, BYTE))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))) for r in docs.collect()]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    counts, ends = collections.Counter(w for i, ws in texts if not out[i] for w in ws), sum(not out[i] for i, _ in texts)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, ws in texts:
        r = got[i][0]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert abs(r.base_score - want) < 1e-6 * abs(want) + 1e-9
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws) + 1, sum(w in counts for w in ws) + 1, n)
    unseen = [r for rs in got.values() for r in rs if r.held_out and r.doc_id < 100_000]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_windows_score_every_id_once():
    starts = np.array([0, 1, 25, 50, 50 + lm_scoring.STRIDE * 3 + 5])
    place, text = lm_scoring.windows(starts)
    scored = place[:, lm_scoring.CONTEXT + 1 :]
    assert sorted(scored[scored >= 0].tolist()) == list(range(starts[-1]))
    assert (place[:, 1:] - place[:, :-1])[(place[:, :-1] >= 0) & (place[:, 1:] >= 0)].max() == 1


def test_model_learns_from_all_training_texts(spark, sf, monkeypatch):
    seen = {}
    prepare = lm_scoring.prepare
    monkeypatch.setattr(lm_scoring, "prepare", lambda *a: seen.update(company=a[5], weights=(m := prepare(*a)).weights.copy()) or m)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words, tokenizer = lm_scoring.count_words(docs), Tokenizer.from_file(BYTE)
    size = tokenizer.get_vocab_size()
    spaced = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
    n = docs.count()
    model, trained = lm_scoring.learn_model(docs, words, n, BYTE, spaced, 50256)
    texts = pa.array([r.text for r in docs.collect()], pa.string())
    ids, starts, *_ = lm_scoring.encode_texts(texts, token_ids.PieceEncoder.of(BYTE), 50256)
    counts = np.bincount(ids, minlength=size).astype(float)
    assert trained == len(ids)
    ranks = np.argsort(model.group_of[model.group_of >= 0])
    ranked = np.flatnonzero(model.group_of >= 0)[ranks]
    assert (np.diff(counts[ranked]) <= 0).all() and np.delete(counts, [*ranked, 50256]).max() <= counts[ranked[-1]]
    assert (seen["company"] == lm_scoring.company_of(ids, starts, lm_scoring.top_subwords(counts), size)).all()
    before = lm_scoring.CausalModel(**{**model.__dict__, "weights": seen["weights"]})
    assert model.log_chances(ids, starts)[0].mean() > before.log_chances(ids, starts)[0].mean() + 0.1


def test_company_of_short_texts():
    for n in range(9):
        company = lm_scoring.company_of(np.arange(n, dtype=np.uint16), np.array([0, n]), np.arange(20), 20)
        assert company.sum() == 2 * sum(max(0, n - gap) for gap in (1, 2, 6))


def test_chances_sum_to_one_over_the_vocabulary(sf, spark):
    """With the real tokenizer, trained weights and counted tables; and those of what begins a word sum to its own chance."""
    tokenizer = Tokenizer.from_file(BYTE)
    size, end = tokenizer.get_vocab_size(), 50256
    spaced = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
    spaced[end] = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, _ = lm_scoring.learn_model(docs, lm_scoring.count_words(docs), docs.count(), BYTE, spaced, end)
    texts = pa.array([r.text for r in docs.limit(3).collect()], pa.string())
    ids, *_ = lm_scoring.encode_texts(texts, token_ids.PieceEncoder.of(BYTE), end)
    for n in (0, 1, 2, 7, 30, 61):
        # The context and each id of the vocabulary behind it: as many texts, scored whole.
        text = np.concatenate([np.append(ids[:n], i) for i in range(size)]).astype(np.uint16)
        starts = np.arange(size + 1) * (n + 1)
        chance, begins = model.log_chances(text, starts)
        last = np.exp(chance[n :: n + 1])
        assert abs(last.sum() - 1) < 1e-5, n
        assert abs(last[spaced].sum() - math.exp(begins[n])) < 1e-5


def test_texts_are_read_once_and_split_into_words_once(spark, hard):
    """The texts go through the whole operator in one pass: counting, training and scoring read their ids."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = hard.where("doc_id is not null").select("doc_id", seen("text").alias("text"))
    assert lm_scoring.score(docs, ~language_id.held_out(F.col("doc_id"), 7, 2), BYTE).count() == docs.count() == len(hard_rows()) - 1
    assert read.value == len(hard_rows()) - 1


def test_gradient_of_the_causal_model():
    """By differences, for every kind of weight; places outside a text count for nothing."""
    rng, n = np.random.default_rng(0), 40
    columns = np.concatenate([np.arange(0, lm_scoring.KIND, 3), np.arange(lm_scoring.KIND + 1, lm_scoring.COLUMNS, 3)])
    width, length = lm_scoring.WIDTH, lm_scoring.LENGTH
    weights = [(rng.standard_normal(s) * 0.3).astype(np.float32) for s in ((n, width), (length, width), (width, width), (width, width), (width + 1, lm_scoring.COLUMNS))]
    model = lm_scoring.CausalModel(*[None] * 9, weights)
    rows = rng.integers(0, n, (5, length))
    wanted = np.where(rng.random(5 * length) < 0.1, -1, rng.choice(columns, 5 * length))

    def loss():
        z = model.forward(rows)[0].astype(float) @ weights[4]
        begins = 1 / (1 + np.exp(-z[:, lm_scoring.KIND]))
        chance = np.exp(z)
        chance[:, : lm_scoring.KIND] *= (begins / chance[:, : lm_scoring.KIND].sum(1))[:, None]
        chance[:, lm_scoring.KIND + 1 :] *= ((1 - begins) / chance[:, lm_scoring.KIND + 1 :].sum(1))[:, None]
        return -np.log(chance[np.arange(len(z)), wanted])[wanted >= 0].mean()

    each, rest = lm_scoring._gradients(model, rows, wanted)
    embed = np.zeros((n, width))
    np.add.at(embed, rows.ravel(), each)
    for w, gradient in zip(weights, [embed, *rest]):
        for _ in range(6):
            at = tuple(rng.integers(0, d) for d in w.shape)
            value = w[at]
            w[at] = value + 0.01
            above = loss()
            w[at] = value - 0.01
            below = loss()
            w[at] = value
            assert abs((above - below) / 0.02 - gradient[at]) < 2e-5


def test_packed_sizes():
    for sizes in ([], [1, 2, 254], [255, 1, 3, 510, 511, 254, 70_000, 1]):
        sizes = np.array(sizes, np.int64)
        packed, bounds = lm_scoring._packed_sizes(sizes, np.arange(len(sizes) + 1))
        assert (lm_scoring._unpacked_sizes(packed) == sizes).all()
        assert all((lm_scoring._unpacked_sizes(packed[bounds[k] : bounds[k + 1]]) == sizes[k : k + 1]).all() for k in range(len(sizes)))


def test_word_memory_gives_the_ids_of_the_library(sf, spark):
    """Also of words that were forgotten, of punctuation, odd white space and added tokens."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += ["über, Straße! <|endoftext|> a<|endoftext|>b ¿qué? don't 'tis ... 12,5 a,b ,,, É. 東京, naïve; 😀! \x00z w\x1cv \xa0x y\xa0", "x" * 5000, "end, end. end"]
    memory, library = token_ids.WordMemory(token_ids.PieceEncoder(BYTE, 500)), Tokenizer.from_file(BYTE)
    for at in range(0, len(texts), 7):
        part = list(dict.fromkeys(w for t in texts[at : at + 7] for w in re.split("[ \t-\r]+", t or "") if w))
        ids, bounds = memory.ids_of(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(" " + w, add_special_tokens=False).ids for w in part]
        assert len(memory.words) <= 500


# --- op5 ---


def brute_links(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = re.split(rb"[ \t-\r]+", (t or "").encode().lower())
        w = [x for x in w if x]
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    links = {k: [j for j in sets if j != k and sets[j] and sets[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])] for k in sets}
    return links


def test_near_duplicates_against_brute_force(spark, hard, empty, sf, tmp_path):
    rng = random.Random(5)
    rows = [(i, t) for i, t, *_ in hard_rows() if i is not None]
    seed = words(rng, 150).split()
    for k in range(60):  # a group of near copies
        copy = seed[:]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = f"edit{k}"
        rows.append((1000 + k, " ".join(copy)))
    path = str(tmp_path / "near")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = rows_by_id(near_duplicates.join(spark.read.parquet(path)))
    want = brute_links(rows)
    for k, (i, _) in enumerate(rows):
        assert {r.n_links for r in got[i]} == {len(want[k])}, i
        assert {r.class_id for r in got[i]} <= {rows[j][0] for j in range(len(rows))}
        for j in want[k]:
            assert got[i][0].class_id == got[rows[j][0]][0].class_id
    assert near_duplicates.join(empty).count() == 0
    kept = near_duplicates.drop_near_duplicates(hard)
    assert kept.columns == hard.columns


def test_blocks_of_a_large_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    seed = words(rng, 100).split()
    rows = [(k, " ".join(seed[:50] + [f"w{k}"] + seed[50:])) for k in range(40)]
    path = str(tmp_path / "large")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = near_duplicates.join(spark.read.parquet(path)).collect()
    want = brute_links(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: len(want[i]) for i in want} and {r.class_id for r in got} == {0}


def test_prefix_length():
    for s in (0.8, 0.9, 0.95):
        d = near_duplicates.prefix_length(s, 0.999)
        assert 1 - (1 - s**d) ** near_duplicates.TREES >= 0.999
    with pytest.raises(ValueError):
        near_duplicates.prefix_length(0.1)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_clusters_hold_all_links_of_mixed_groups(spark, tmp_path, monkeypatch, threshold):
    """Several families of copies that share branches, blocks of a few rows, repeated and null doc_ids."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 4)
    rng = random.Random(8)
    rows = []
    for family in range(6):
        seed = words(rng, 60).split()
        for k in range(12):
            copy = seed[:]
            for _ in range(rng.randint(0, 2 + family)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((rng.choice([None, 1, 2, 100 * family + k]), " ".join(copy)))
    rows += rows[:5]
    path = str(tmp_path / "families")
    spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, __row int").write.parquet(path)
    docs = spark.read.parquet(path)
    got = collections.Counter((r.doc_id, r.n_links) for r in near_duplicates.join(docs, threshold, 0.999).collect())
    want = collections.Counter()
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)))
    near = lambda a, b: len(a & b) >= threshold * len(a | b)
    for k, (i, _) in enumerate(rows):
        want[i, sum(near(sets[k], sets[j]) for j in range(len(rows)) if j != k)] += 1
    assert got == want
    kept = near_duplicates.drop_near_duplicates(docs, threshold, 0.999).collect()
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if near(sets[j], sets[k])) for k in range(len(rows))]
    assert collections.Counter(label[r["__row"]] for r in kept) == collections.Counter(set(label))


def test_weak_links_shorten_prefixes(spark, monkeypatch):
    used = []
    whole = near_duplicates._branches
    monkeypatch.setattr(near_duplicates, "_branches", lambda nodes, length: used.append(length) or whole(nodes, length))
    rng = np.random.default_rng(2)
    n = near_duplicates.TREES * near_duplicates.DEPTH

    def clusters(changed):
        first = rng.integers(0, 1 << 16, n).astype(">u2")
        rows = [(0, bytearray(first.tobytes()))]
        other = first.copy()
        other[rng.permutation(n)[:changed]] = 1
        rows.append((1, bytearray(other.tobytes())))
        nodes = spark.createDataFrame(rows, "node bigint, labels binary")
        used.clear()
        return near_duplicates.candidate_clusters(nodes).count(), list(used)

    assert clusters(1) == (2, [8])  # copies that are all but equal are found at full length
    found, lengths = clusters(25)
    assert found == 2 and lengths[0] == 8 and lengths[-1] < 8
    assert clusters(n)[0] == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(4)
    for text in (words(rng, 3000), "x" * 9000 + " a b", " ".join(["loop"] * 2000), words(rng, 4) + " " * 5000 + words(rng, 3)):
        want = near_duplicates._short_sets(pa.array([text]))[0].tolist()
        for size in (64, 500, 10_000):
            monkeypatch.setattr(near_duplicates, "TEXT_BYTES", size)
            assert near_duplicates.shingle_sets(pa.array([text]))[0].tolist() == want


# --- op6 ---


@pytest.mark.parametrize("block", [3, 64, exact_dedup.BLOCK_BYTES])
def test_exact_duplicates(hard, block):
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = [r for r in hard_rows() if r[0] is not None and (block > 3 or len(r[1] or "") < 2000)]
    df = hard.where("doc_id is not null") if block > 3 else hard.where("doc_id is not null and length(coalesce(text, '')) < 2000")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = rows_by_id(exact_dedup.dedup(df, block))
    for i, t, *_ in rows:
        for r in got[i]:
            assert (r.keep_id, r.group_size) == (max(groups[norm(t)]), len(groups[norm(t)]))
            assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    assert sum(r.kept for rs in got.values() for r in rs) == len(groups)
    assert all(sum(r.kept for r in rs) <= 1 for rs in got.values())


def test_kept_rows_do_not_depend_on_splits(spark, tmp_path):
    """File splits follow the number of executors, which may change between building a query and running it."""
    path = str(tmp_path / "many")
    texts = [f"text {k % 37} of a table with many files and some words more" for k in range(400)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(24, "doc_id").write.parquet(path)
    last = {t: k for k, t in enumerate(texts)}
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    try:
        for drop in (exact_dedup.drop_duplicates, near_duplicates.drop_near_duplicates):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
            kept = drop(spark.read.parquet(path))
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "12")
            got = {r.text: r.doc_id for r in kept.collect()}
            if drop is exact_dedup.drop_duplicates:
                assert got == last
            else:
                assert all(last[t] == i for t, i in got.items()) and len(got) <= 37
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)


def test_blocks_whose_codes_differ_have_one_name(spark, tmp_path):
    """Executors with other versions of the coder give other codes for the same bytes; two blocks may share a tag."""
    import zstandard

    a, b = b"some bytes " * 50, b"other bytes " * 50
    pack = lambda raw, other: bytearray(zstandard.ZstdCompressor(write_checksum=other).compress(raw))
    rows = [(0, b"t", pack(a, False)), (1, b"t", pack(a, True)), (2, b"t", pack(b, False)), (3, b"u", pack(b, False)), (4, b"u", pack(b, False))]
    assert rows[0][2] != rows[1][2]
    pieces = spark.createDataFrame([(u, bytearray(t), c) for u, t, c in rows], "uid bigint, tag binary, code binary")
    name = {r.uid: r.name for r in exact_dedup._named_blocks(materialise(pieces, "test")).collect()}
    assert name[0] == name[1] != name[2] and name[3] == name[4] and len(name) == 5


def test_exact_duplicates_of_nothing_and_kept_rows(hard, empty):
    assert exact_dedup.dedup(empty).count() == 0
    kept = exact_dedup.drop_duplicates(hard)
    assert kept.columns == hard.columns
    assert kept.count() == len({(t or "").lower() if (t or "").isascii() else t for _, t, *_ in hard_rows()})


# --- op7, op10 ---


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path):
    texts = [t for _, t, *_ in hard_rows()] + ["a  b", " x \n y", "\n\nz ", "don't  stop\t now", "tab\tx \tq", "nbsp\xa0 x", "<|endoftext|> x", "é ́a"]
    encoder = token_ids.PieceEncoder(path)
    whole = [e.ids + [2] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for chunk in (1, 4, len(texts)):
        got = []
        for at in range(0, len(texts), chunk):
            flat, starts = encoder.encode(pa.array(texts[at : at + chunk], pa.string()), 2)
            got += [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        assert got == whole


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_rare_pieces_are_forgotten(path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "Über", "x,"]) + rng.choice(["", ".", "abc", str(rng.random())]) for _ in range(30)) for _ in range(200)]
    encoder = token_ids.PieceEncoder(path, remembered=200)
    whole = Tokenizer.from_file(path)
    for at in range(0, len(texts), 8):
        flat, starts = encoder.encode(pa.array(texts[at : at + 8]), 2)
        for k, text in enumerate(texts[at : at + 8]):
            assert flat[starts[k] : starts[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids + [2]
    assert len(encoder._place) < 2000


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (5, 0, 100, 3, 3, 3, 50, 1)])], names=["text"])
    assert [len(s) for s in token_ids.slices([batch], 0, rows=3, most=10)] == [2, 1, 3, 1, 1]


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1, 5, 2**63, 1 << 60, (1 << 60) - 1], [0] * 500, list(range(1000)), [1] * 61 + [7]])
def test_simple8b(values):
    v = np.array(values, np.uint64)
    encoded, packed = token_output.encode(v)
    assert token_output.decode(encoded, packed, len(v)).tolist() == values


def test_token_files(spark, hard, empty):
    path = scratch_path(spark, "test")
    token_output.write_token_files(hard, path, BYTE, block_tokens=500)
    tokenizer = Tokenizer.from_file(BYTE)
    rows = sorted(((i, t or "") for i, t, *_ in hard_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_output.digest_token_files(spark, path).collect()), key=lambda r: r[1]) == want
    assert sum(len(r.ids) for r in token_output.read_token_files(spark, path).collect()) == at
    none = scratch_path(spark, "test")
    token_output.write_token_files(empty, none, BYTE)
    assert token_output.digest_token_files(spark, none).count() == 0


def test_packing(hard, empty):
    got = packing.pack(hard, WORD).collect()
    tokenizer = Tokenizer.from_file(WORD)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, *_ in hard_rows()}
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, *_ in hard_rows())
    by_sequence = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("limits", [(100, 4, 100), (100, 10, 40), (64, 2, 64)])
def test_vector_limits(limits):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 300, 200)
    losses = rng.integers(0, lengths + 1)
    placed, rest = packing.pack_pieces(lengths, losses, limits, True)
    assert not rest
    pieces = collections.defaultdict(list)
    for sequence in placed:
        assert sum(n for *_, n in sequence) <= limits[0] and len(sequence) <= limits[1]
        assert sum(n * losses[d] / lengths[d] for d, _, n in sequence) <= limits[2] + 1e-6
        for d, s, n in sequence:
            pieces[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(pieces[d]):
            assert s == at
            at += k
        assert at == n


# --- op8 ---


def test_fingerprints(spark, hard, empty):
    rows = sorted(((i, t or "") for i, t, *_ in hard_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = fingerprints.edits(hard).collect()
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[1] and prints[7] == prints[8] == prints[16] != prints[10]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edits(empty).count() == 0
    assert fingerprints.edits(hard.limit(1)).count() == 1


def test_fingerprints_over_ranges(spark, hard, monkeypatch):
    one = sorted(map(tuple, fingerprints.edits(hard).collect()), key=str)
    for rows, quantiles, broadcast in ((3, 8192, 100), (2, 3, 0)):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
        monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
        monkeypatch.setattr(fingerprints, "BROADCAST_RANGES", broadcast)
        assert sorted(map(tuple, fingerprints.edits(hard).collect()), key=str) == one


def test_fingerprints_of_hot_ids_and_by_brute_force(spark, tmp_path, monkeypatch):
    """Half of the rows share a doc_id or have none: they lie in several ranges, and neighbours stay the same.  Lanes and likeness are made again in Python."""
    import xxhash

    rng = random.Random(9)
    rows = [(rng.choice([None, 5, 5, 5, k, 1 << 60, (1 << 60) + 1]), words(rng, rng.randint(0, 12)) + rng.choice(["", ". " + words(rng, 3), "\n" + words(rng, 2)])) for k in range(120)]
    path = str(tmp_path / "hot")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)

    def tie(t):
        x = xxhash.xxh64_intdigest(t.encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))

    def vector(t):
        parts = re.split(r"\n|(?<=[!-/:-@\[-`{-~]) ", t)
        lanes = [0] * fingerprints.LANES
        for part in parts:
            for k in range(2):
                seed = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)
                h = xxhash.xxh64_intdigest(part.encode(), seed)
                for j in range(31):
                    lanes[62 * k + 2 * j] += 1 if h >> j & 1 else -1
                    lanes[62 * k + 2 * j + 1] += 1 if h >> (j + 31) & 1 else -1
        return len(parts), [(x + (1 << 15)) % (1 << 16) - (1 << 15) for x in lanes]

    def like(a, b):
        if a == b:
            return 1.0
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b)) / norm)) if norm else 0.0

    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        (n, a), (_, b), (_, c) = vector(t), vector(edited), vector(nxt)
        text = f"{n:08x}" + "".join(f"{x & 0xFFFF:04x}" for x in a)
        want.append((i, hashlib.sha256(edited.encode()).hexdigest(), text, round(like(a, b), 9), round(like(a, c), 9)))
    for size, quantiles in ((512, 8192), (4, 8192), (2, 4)):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
        monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
        got = [(r.doc_id, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.edits(docs).collect()]
        assert collections.Counter(got) == collections.Counter(want)
    spread = fingerprints.with_next(docs).where("last = 0 and doc_id = 5").select("range").distinct().count()
    assert spread > 3


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("ab", "x one\ny two\nz three"), ("ba", "z three\nx one\ny two"), ("a", "x one\ny two"), ("b", "z three")], "k string, t string")
    f = {r.k: r for r in fingerprints.fingerprint(df, "k", "t").collect()}
    assert f["ab"].fingerprint == f["ba"].fingerprint != f["a"].fingerprint
    joined = spark.createDataFrame([(f["a"].lanes, f["b"].lanes, f["ab"].lanes)], "a array<int>, b array<int>, ab array<int>")
    r = joined.select(fingerprints.combine(F.col("a"), F.col("b")).alias("plus"), fingerprints.combine(F.col("ab"), F.col("b"), -1).alias("minus")).first()
    assert r.plus == f["ab"].lanes and r.minus == f["a"].lanes


# --- op9 ---


def test_quality(spark, hard, empty, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.score(docs, trees, [F.col("doc_id")]).collect() if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.9 * len(got)
    all_ = quality.score(hard, trees, [F.col("doc_id")]).collect()
    assert len(all_) == len(hard_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in all_)
    assert quality.score(empty, trees, [F.col("doc_id")]).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none, [F.col("doc_id")]).count() == docs.count()


def test_trees_learn_and_statistics_do_not_depend_on_groups(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.boost(x, y).score(x) > 0.5) == (y > 0)).mean() > 0.95
    texts = pa.array([t for _, t, *_ in hard_rows()], pa.string())
    whole = quality.statistics(texts)
    monkeypatch.setattr(quality, "GROUP_BYTES", 10)
    assert np.allclose(whole, quality.statistics(texts))


def test_quality_by_brute_force():
    """Statistics counted one by one, and trees walked node by node."""
    texts = [t or "" for _, t, *_ in hard_rows() if len(t or "") < 3000] + ["two  words.\nA line\nA line\n", "!!! ??? a a a"]
    x = quality.statistics(pa.array(texts, pa.string()))
    for row, text in zip(x, texts):
        raw = text.encode()
        size = max(1, len(raw))
        share = lambda chosen: sum(b in chosen for b in raw) / size
        letters = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        want = [math.log1p(len(text)), share(letters), share(set(range(65, 91))), share(set(b"0123456789")), share(set(range(128, 256))), share({10}), share(set(b" \t\n\x0b\x0c\r"))]
        want += [share({ord(m)}) for m in quality.MARKS]
        found = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
        n = max(1, len(found))
        want += [math.log1p(len(found)), sum(map(len, found)) / n, math.sqrt(sum(len(w) ** 2 for w in found) / n)]
        want += [sum(a == b for a, b in zip(found, found[1:])) / n, len(set(found)) / n]
        assert np.allclose(row[: len(want)], want)
    rng = np.random.default_rng(3)
    data = rng.random((500, x.shape[1]))
    trees = quality.boost(data, (data[:, 0] + data[:, 5] > 1).astype(float))
    for row, score in zip(data[:50], trees.score(data[:50])):
        total = trees.base
        for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > bound[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_language_by_brute_force():
    """Margins of every machine by hashing one n-gram at a time, then families, then votes."""
    rng = np.random.default_rng(5)
    model = language_id.LanguageModel(["de", "en", "es", "fr"])
    size = len(language_id.SIZES) * language_id.BUCKETS
    for machine in range(4):
        model.weights.append(rng.standard_normal(size).astype(np.float32))
        model.bias.append(float(rng.standard_normal()))
        model.slope.append(1.5)
    model.families = {"germanic": 0, "romance": 1}
    model.pairs = {("de", "en"): 2, ("es", "fr"): 3}
    texts = ["Größe und Maß", "the cat sat", "", "12 34", "un peu de tout", "a", "x y z " * 50]
    normal = language_id.letters(pa.array(texts))
    langs, scores = model.predict(normal)
    for text, lang, score in zip(normal.to_pylist(), langs, scores):
        raw = np.frombuffer(text.encode(), np.uint8)
        if not text.strip():
            assert (lang, score) == ("und", 0)
            continue
        chance = []
        for w, b, slope in zip(model.weights, model.bias, model.slope):
            m = b
            for i, n in enumerate(language_id.SIZES):
                grams = len(raw) - n + 1
                for k in range(grams):
                    m += w[int(language_id._hashes(raw[k : k + n], n)[0]) + i * language_id.BUCKETS] * language_id._SCALE / max(1, grams)
            chance.append(1 / (1 + math.exp(-slope * m)))
        family = 0 if chance[0] >= chance[1] else 1
        first, second = (("de", "en"), ("es", "fr"))[family]
        vote = chance[2 + family]
        assert lang == (first if vote >= 0.5 else second)
        assert abs(score - chance[family] / (chance[0] + chance[1]) * max(vote, 1 - vote)) < 1e-4
