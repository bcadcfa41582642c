"""Each operator on small tables with nulls, blanks, repeats, ties and clashing columns,
against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import common, decontam, encoder, langid, linededup, mixing, pii, qda, quality_rules, registry, simhash, tokencounts, tokenfile

WORDS = "the of and in to model data train corpus line word river stone green light paper house window garden music".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, prose(rng, rng.randrange(1, 120)), "en", f"s{k % 4}", 0) for k in range(60)]
    long = prose(rng, 3000)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    out += [
        (100, base, "en", "s0", 1), (101, base, "en", None, 1), (102, " ".join(near), "en", "s1", 1),
        (103, None, None, None, None), (104, "", "fr", "s2", 0), (105, " \n\t ", "fr", "s2", 0), (106, long, "en", "s3", 0),
        (107, "Hello World.\nHello World.\n\nsome other line here that is long\nsome other line here that is lonk", "de", "s1", 0),
        (107, "Hello World.\nHello World.\n\nsome other line here that is long\nsome other line here that is lonk", "de", "s1", 0),
        (None, "a row without an id", "en", "s1", 0), (108, "12345 67890", None, "s0", 0), (109, "é" * 5000, "es", "s0", 0),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Also with columns whose names operators use on their own."""
    extra = ["key", "id", "fp", "size", "count", "_id", "votes", "lang_pred", "base"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in extra}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The small table as documents.parquet, with a benchmark and labels."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "what is the river stone of the green house window? the answer is music garden light"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60, 3)] + [(100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_query_runs_on_the_edge_cases(spark, folder, rows):
    for name, query in registry.queries().items():
        out = query(spark, folder).collect()
        if name.split("_")[0] in ("op1", "op2", "op4", "op6", "op7", "op8", "op9", "op10"):
            assert len(out) == len(rows), name


def test_every_query_runs_on_empty_tables(spark, empty, tmp_path):
    at = str(tmp_path)
    empty.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    for name, query in registry.queries().items():
        assert query(spark, at).count() == 0, name


# 1

def test_language_id_learns_and_rejects(spark):
    rng = random.Random(1)
    syllables = {"aa": ["tha", "ing", "wh", "er"], "bb": ["sch", "ung", "ei", "pf"], "cc": ["ción", "llo", "ñe", "rra"]}
    text = lambda n: " ".join("".join(rng.choice(syllables[n]) for _ in range(3)) for _ in range(30))
    data = [(k, text(n), n) for k in range(240) for n in [["aa", "bb", "cc"][k % 3]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fitted(df, F.col("doc_id") % 4 != 2)
    out = langid.identified(df.where("doc_id % 4 = 2"), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.lang_score <= 1 and not r.lang_rejected for r in out)
    names, scores = model.predict([None, "", "123 !!", text("bb")])
    assert names[:3] == ["und"] * 3 and list(scores[:3]) == [0, 0, 0] and names[3] == "bb"


def test_language_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = ["some words of text " * 40, "ñandú", "x", "über " * 200]
    whole = model.means(texts)
    bags = [langid.bag(t) for t in texts]
    assert np.allclose(whole, [(c[:, None] * model.logits[b]).sum(0) / c.sum() for b, c in bags], atol=1e-4)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(model.means(texts), whole)


# 2

def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, text, n, letters):
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        what = rng.random()
        if what < 0.34:
            s.insert(k, rng.choice(letters))
        elif what < 0.67:
            s[k] = rng.choice(letters)
        elif len(s) > 1:
            del s[k]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(600):
        letters = rng.choice(["ab", "abcé", "abcdefgh"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 5, 9, 40])))
        pairs.append((a, edited(rng, a, rng.randrange(5), letters)))
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert [r.w for r in out] == [edit_distance(r.a, r.b) <= edits for r in out]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([8, 9, 12, 18, 20, 24, 30, 61]))).strip() + "z" for _ in range(25)]
    lines = [edited(rng, rng.choice(base), rng.randrange(4), "abcdefghij") for _ in range(160)] + ["short", "shorn", "short"]
    docs = [(k // 5, " \t" * (k % 2) + "\n".join(lines[k : k + 5])) for k in range(0, len(lines), 5)]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.n_near) for r in linededup.by_document(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    places = [(d, i, x.strip(" \t")) for d, t in docs for i, x in enumerate(t.split("\n")) if x.strip(" \t")]
    texts = sorted({x for _, _, x in places})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if a != b and edit_distance(a, b) <= min(linededup.EDITS, min(len(a), len(b)) // linededup.CHARS_AN_EDIT):
                root[find(a)] = find(b)
    size = {}
    for x in texts:
        size[find(x)] = size.get(find(x), 0) + 1
    want, seen = {d: [0, 0, 0] for d, _ in docs}, set()
    for d, _, x in places:
        c = find(x)
        want[d][0] += 1
        want[d][1] += c not in seen
        want[d][2] += size[c] > 1
        seen.add(c)
    assert got == {d: tuple(v) for d, v in want.items()}
    assert any(v[2] for v in want.values())


def test_line_classes_and_links_against_all_pairs(spark):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([8, 13, 18, 24, 30, 61]))).strip() + "z" for _ in range(12)]
    lines = [edited(rng, rng.choice(base), rng.randrange(4), "abcdefghij") for _ in range(100)] + ["short", "shorn", "short"]
    docs = [*((k // 5, "\n\n".join(lines[k : k + 5])) for k in range(0, len(lines), 5)), (900, None)]
    out = linededup.by_document(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_lines == len(r.lines) and r.n_kept == sum(x.kept for x in r.lines) for r in out)
    got = {(r.doc_id, x.pos): x for r in out for x in r.lines}
    text = {(d, i): x.strip(" ") for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" ")}
    texts = set(text.values())
    near = {a: {b for b in texts - {a} if a != b and edit_distance(a, b) <= min(linededup.EDITS, min(len(a), len(b)) // linededup.CHARS_AN_EDIT)} for a in texts}
    assert got.keys() == text.keys() and any(len(x) > 1 for x in near.values())
    assert {k: x.n_links for k, x in got.items()} == {k: len(near[x]) for k, x in text.items()}

    def reached(x):
        seen, queue = {x}, [x]
        while queue:
            new = near[queue.pop()] - seen
            seen |= new
            queue += new
        return frozenset(seen)

    assert len({(x.class_id, reached(text[k])) for k, x in got.items()}) == len({x.class_id for x in got.values()}) == len({reached(x) for x in texts})
    assert {x.class_id for x in got.values() if x.kept} == {x.class_id for x in got.values()}


def test_line_dedup_of_clashing_names_and_an_empty_table(spark, empty):
    df = spark.createDataFrame([(1, "a line of some length", 5, 6), (2, "a line of some length\nx", None, 7)], "doc_id long, text string, __id int, __keep int")
    assert sorted(map(tuple, linededup.deduplicated(df).collect())) == [(1, "a line of some length", 5, 6), (2, "x", None, 7)]
    assert linededup.deduplicated(empty).count() == 0


def test_deduplicated_lines_keep_the_first(spark):
    df = spark.createDataFrame([(2, "x\nsame line of some length\nw"), (1, "same line of some length\n\ny"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.deduplicated(df).collect()} == {1: "same line of some length\ny", 2: "x\nw", 3: None}


# 3

def test_tokens_go_to_the_section_that_holds_most():
    start, end = np.array([0, 3, 8, 12, 20]), np.array([3, 8, 10, 15, 22])
    low, high = np.array([0, 5, 10]), np.array([5, 10, 14])
    best, crosses = tokencounts.attribute(start, end, low, high)
    assert best.tolist() == [0, 1, 1, 2, -1] and crosses.tolist() == [False, True, False, True, False]
    best, _ = tokencounts.attribute(np.array([3]), np.array([7]), low, high)
    assert best.tolist() == [0]  # of equals the earlier


def test_section_counts_add_up(spark, docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    halves = lambda t: [("a", 0, len(t) // 2), ("b", len(t) // 2, len(t))]
    for sections in (tokencounts.line_kinds, halves):
        got = {}
        for r in tokencounts.by_section(docs.where("doc_id <> 107"), P.path("byte_bpe_50k.json"), P.PATTERN, sections=sections).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert got == {d: len(own.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows if d not in (107, None)}


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", None)])
def test_piece_encoder_is_exact(monkeypatch, rows, name, cut):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = cut is None
    odd = ["a  b c\n\n\td<|endoftext|>x", "É́t é ﬁ İstanbul 'S IT'S don't 123 \x1c x　y 😀a‍b", "Thing, thing. THING! ẞ. word.. a, ,. . ŉ.", "<|EndOfText|> A", "İ, Ünï. ſ! ×, x×; Ω. Σας, ΣΑΣ", "a\r\nb\x0bc\x0cd", "w" * 500 + " " + "é" * 300]
    texts = [t or "" for _, t, *_ in rows] + odd
    want = whole.encode_batch(texts, add_special_tokens=False)
    ids, start, end, n = encoder.PieceEncoder(P.path(name), cut or P.PATTERN).encode(texts)
    assert ids.tolist() == [i for e in want for i in e.ids] and n.tolist() == [len(e.ids) for e in want]
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [o for e in want for o in e.offsets]
    # a small table that is trimmed again and again gives the same
    monkeypatch.setattr(encoder, "MOST_PIECES", 50)
    monkeypatch.setattr(encoder, "MOST_WORDS", 50)
    small = encoder.PieceEncoder(P.path(name), cut or P.PATTERN)
    assert [i for t in texts * 2 for i in small.encode([t])[0].tolist()] == [i for e in want for i in e.ids] * 2 and len(small.table) < 5000
    if cut:
        for own in (encoder.ColumnEncoder(P.path(name)),):
            ids, n = own.encode(pa.array(texts))
            assert ids.tolist() == [i for e in want for i in e.ids] and n.tolist() == [len(e.ids) for e in want]
            assert [i for t in texts * 2 for i in own.encode(pa.array([t]))[0].tolist()] == [i for e in want for i in e.ids] * 2
        assert own.encode(pa.array([], pa.string()))[0].tolist() == [] and own.encode(pa.array(["", ""]))[1].tolist() == [0, 0]


# 4

def test_mixing_meets_targets(spark, docs, rows):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    size, want = {}, {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and weight[s] * level > 3 * size[s]}
        if not new:
            break
        full |= new
    want = {s: min(3 * size[s], weight[s] * level) for s in order}
    taken = {}
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    longest = max(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], longest if s == "s3" else 20) for s in order)
    assert len({r.rate for r in out if r.source == "s0"}) > 3  # rates are of documents, not of sources
    again = mixing.mixed(docs.repartition(5)).collect()
    key = lambda r: (r.id is None, r.id or 0, r.size, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixing_takes_few_jobs(spark):
    data = [(k, " ".join(["w"] * (1 + k * k % 97)), f"s{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    total = lambda: spark._jsc.sc().dagScheduler().numTotalJobs()
    before = total()
    assert mixing.mixed(docs).count() == 400
    assert total() - before < 110  # a query for each round and repair took the driver's memory


def test_mixing_rates_against_a_plain_solver(spark):
    """Exponentials of document sizes, held at 3, whose words meet each target."""
    rng = random.Random(4)
    data = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 31, 200, 2000])), f"s{k % 5}") for k in range(400)]
    out = mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        sizes, target, scale = np.array([r.size for r in own]), own[0].target, max(1.0, sum(r.size for r in own) / len(own))
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * np.minimum(3, np.exp(np.minimum(mid * sizes / scale, 50)))).sum() < target else (low, mid)
        want = np.minimum(3, np.exp(np.minimum(low * sizes / scale, 50)))
        assert abs(sum(r.size * r.rate for r in own) - target) <= 1e-5 * target
        if target < 2.99 * sizes.sum():
            assert np.allclose([r.rate for r in own], want, rtol=1e-4) and len({r.rate for r in own}) > 3
        assert abs(sum(r.size * r.copies for r in own) - target) <= 35
        assert all(0 <= r.copies <= 3 and (r.size or r.copies == 1) for r in own)


def test_replicated_keeps_columns_and_empty_tables(spark, docs, rows, empty):
    clash = docs.withColumns({"multiplier": F.lit(1), "dither": F.lit("x"), "copies": F.lit(9), "__row": F.lit(0)})
    out = mixing.replicated(clash)
    assert out.columns == clash.columns
    taken = {}
    for r in mixing.mixed(docs).collect():
        taken[r.id] = taken.get(r.id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in out.drop("count").groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in taken.items() if n}
    assert mixing.replicated(empty).count() == 0 and mixing.replicated(empty).columns == empty.columns


# 5

def test_leaks_against_shingle_containment(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(12, 50)) + ". " + prose(rng, 8) + ".") for k in range(40)]
    docs = []
    for k in range(120):
        text = prose(rng, rng.randrange(5, 400))
        if k % 4 == 0:
            text += "\n" + items[k % 40][1].upper() + "\n" + prose(rng, 50)
        if k % 10 == 1:  # half an item is no leak
            text += " " + " ".join(items[k % 40][1].split()[:8])
        docs.append((k, text))
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    want = {(d, i) for d, t in docs for i, x in items if len(grams(words(x)) & grams(words(t))) >= 0.8 * len(grams(words(x)))}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.found(df, bench).collect()} == want and len(want) == 30
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_question_alone_is_retrieved(spark):
    """Questions that carry little of their item's weight, whole or with a fifth of the shingles gone."""
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(5, 40)) + " answer: " + prose(rng, rng.randrange(1, 60))) for k in range(60)]
    docs = [(k, f"{prose(rng, rng.randrange(300))} {t.split(' answer: ')[0]} {prose(rng, rng.randrange(300))}") for k, t in items]
    for k, t in items:
        q = t.split(" answer: ")[0].split()
        cut = (len(q) - 4) // 5
        docs.append((100 + k, f"{prose(rng, 40)} {' '.join(q[cut:])} {prose(rng, 40)}"))
        docs.append((200 + k, f"{prose(rng, 40)} {' '.join(q[: len(q) // 2])}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontam.found(df, bench).collect()
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    want = {(d, i) for d, t in docs for i, x in items if len((g := grams(words(x.split(" answer: ")[0]))) & grams(words(t))) >= 0.8 * len(g)}
    assert {(r.doc_id, r.item_id) for r in out} == want and len(want) >= 120
    assert all(0 < r.score <= 1 + 1e-9 for r in out) and min(r.score for r in out) < 0.6
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("cursors", [1 << 17, 300])
def test_retrieval_is_exact_for_the_threshold(monkeypatch, cursors):
    monkeypatch.setattr(decontam, "CURSORS", cursors)
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randrange(3, 30))) for k in range(100)]
    df = {}
    for _, t in items:
        for w in set(decontam.WORD.findall(t)):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), 15.0, 0.3, 5, 0.8)
    queries = [np.array(sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(0, 200))), np.int64) for _ in range(200)]
    of = np.repeat(index.block_key[:-1] // (index.blocks + 1), np.diff(index.block_start[:-1]))
    for terms, got in zip(queries, index.retrieve(queries), strict=True):
        score = np.zeros(len(items))
        here = np.isin(of, terms)
        np.add.at(score, index.item[here], index.impact[here])
        assert set(got) == set(np.flatnonzero(score >= 0.3 - 1e-9).tolist())
        assert all(abs(score[k] - x) < 1e-9 for k, x in got.items())
    assert index.retrieve([]) == []


def test_pivots_pass_over_blocks_and_maxima_over_postings():
    """Rare words stand in few of many items, common ones in all: few blocks are met, fewer scored."""
    rng = random.Random(7)
    items = [(k, "the of and to in " + " ".join(f"w{rng.randrange(20_000)}" for _ in range(20))) for k in range(4_000)]
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), 25.0, 0.6, 5, 0.8)
    texts = ["the of and to in " + " ".join(f"w{rng.randrange(20_000)}" for _ in range(60)) + (" " + items[k][1] if k % 5 == 0 else "") for k in range(100)]
    found = [[x.item for x in y] for y in index.leaks(texts)]
    assert all(found[k] == ([k] if k % 5 == 0 else []) for k in range(100))
    assert index.blocks == 250 and 0 < index.scored < index.steps < 0.3 * 100 * index.blocks


def test_an_answer_decides_with_half_of_its_question(spark):
    q, a = "what stands upon the old river bridge near our town hall today", "a grey stone figure that looks far over the quiet water each morning"
    docs = [(1, f"x {q} y"), (2, f"x {a} y"), (3, f"so what stands upon the old river bridge near it {a} y"), (4, f"{q[:30]} y"), (5, f"x {q} answer {a} y"), (6, None)]
    bench = spark.createDataFrame([(7, f"{q} answer: {a}")], "item_id long, text string")
    out = decontam.found(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.kind) for r in out} == {(1, "question"), (3, "answer"), (5, "question")}


# 6

def plain_spans(t):
    def luhn(s):
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
        return sum(x - 9 * (x > 9) for x in d) % 10 == 0

    n = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(n(m)) <= 19 and luhn(n(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(n(m)) <= 15]
    return out


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(7)
    bits = ["a@b.c", "x.y@d-e.f.g.", "@", "%z@q.r..s", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "4111  1111 1111 1111",
            "+1 (234) 555-6789", "+1234567", "+49 30.1234 567 ", "++12 345678", " ", "\n", "é", "😀", "word", ".", "-", "7", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += ["1" * 60_000, "a" * 60_000, "1 " * 30_000, "a@" * 20_000, ".1" * 20_000, "+1" + "-" * 20_000, "x@y" + ".z" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.with_spans(df).select("doc_id", pii.joined(F.col("pii_base")).alias("s")).collect()
    for r in out:
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id])), texts[r.doc_id][:80]


def test_added_spans_and_masking(spark):
    text = "bank DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00, phone 030 1234 5678, mail a@b.cd"
    row = pii.with_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.kind, text[s.start : s.end]) for s in row.pii_added] == [("iban", "DE89 3704 0044 0532 0130 00"), ("local_phone", "030 1234 5678")]
    masked = pii.redacted(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert masked[0].text == "bank [IBAN] or DE88 3704 0044 0532 0130 00, phone [LOCAL_PHONE], mail [EMAIL]" and masked[1].text is None


def test_pii_digest(spark, folder, rows):
    got = sorted(((r.doc_id or -1, r.base_sha256) for r in registry.op6_pii(spark, folder).collect()))
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")).encode()).hexdigest()
    assert got == sorted((-1 if d is None else d or -1, digest(t)) for d, t, *_ in rows)


# 7

def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(windows) < 1500 else {x for x in set(windows) if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in again for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_against_plain_python(spark, rows):
    extra = [(200, "a b c a b c a b c d e f"), (201, "x x x x x"), (202, "a b a b"), (203, "l1\n l1\nl1\n\n\nl1 "), (204, "## | a\x0bb\x0cc\rd é"), (205, "no\xa0break here")]
    data = [(d, t) for d, t, *_ in rows] + extra
    out = quality_rules.measured(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted(plain_measures(t) for _, t in data)


def test_weak_supervision_keeps_prose_and_drops_junk(spark):
    rng = random.Random(8)
    good = [(k, ". ".join(prose(rng, 12).capitalize() for _ in range(8)) + ".") for k in range(150)]
    bad = [(200 + k, " | ".join(prose(rng, 1) + "%%" for _ in range(90))) for k in range(20)] + [(300 + k, " ".join(w.upper() + "!!" for w in prose(rng, 90).split())) for k in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(kept[k] for k, _ in good) and not any(kept[k] for k, _ in bad)


def test_posterior_decides_on_the_sample(spark):
    """Labels only measure: most bad texts go, most by the posterior alone, and good ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = quality_rules.judged(docs.select("doc_id", "text")).collect()
    bad = [r for r in out if labels.get(r.doc_id) == 0]
    good = [r for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.posterior < 0.5 and not r.base_failed for r in bad) >= 0.3 * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in out)
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in out)


def test_posterior_against_plain_python(spark):
    """Expectation-maximisation document by document, without patterns."""
    rng = random.Random(12)
    truth = [rng.random() < 0.8 for _ in range(400)]
    right = [0.95, 0.9, 0.8, 0.85]
    votes = [[0 if rng.random() < 0.2 else (1 if y else -1) * (1 if rng.random() < a else -1) for a in right] for y in truth]
    q = [0.1 if -1 in v else 0.95 for v in votes]
    for _ in range(2000):
        g, n = sum(q), len(q)
        chance = {}
        for j in range(4):
            for v in (-1, 0, 1):
                a = (sum(x for x, w in zip(q, votes, strict=True) if w[j] == v) + 0.5) / (g + 1.5)
                b = (sum(1 - x for x, w in zip(q, votes, strict=True) if w[j] == v) + 0.5) / (n - g + 1.5)
                chance[j, v] = ((a + b) / 2,) * 2 if v * (a - b) < 0 else (a, b)
        p = (g + 1) / (n + 2)
        last = q
        q = []
        for w in votes:
            a, b = p, 1 - p
            for j in range(4):
                a, b = a * chance[j, w[j]][0], b * chance[j, w[j]][1]
            q.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(q, last, strict=True)) < 1e-9:
            break
    df = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "id int, votes array<tinyint>")
    prior, chances = quality_rules.learned(df, 4)
    got = {r.id: r.p for r in df.select("id", quality_rules.posterior(prior, chances).alias("p")).collect()}
    assert all(abs(got[k] - x) < 1e-5 for k, x in enumerate(q))
    names = [(str(j), "", "") for j in range(4)]
    found = quality_rules.accuracies(prior, chances, names)
    assert all(abs(found[str(j)] - a) < 0.08 for j, a in enumerate(right))


# 8

def test_fingerprint_against_plain_python():
    import xxhash

    for text in ["", None, " ", "One", "a b c", "The Quick brown fox Jumps over É the lazy dog", "ab " * 300]:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h) and h)


@pytest.mark.parametrize("radius,block,held", [(1, 20_000, 400_000), (4, 20_000, 400_000), (4, 7, 400_000), (7, 20_000, 400_000), (4, 20_000, 12)])
def test_links_against_all_pairs(spark, monkeypatch, radius, block, held):
    """Also with keys so hot that they are dealt over blocks or linked a part at a time."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "MOST_HELD", held)
    monkeypatch.setattr(simhash, "ROW_COST", 1e6 if held < 100 else 1.0)
    if held < 100:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 9)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), radius)
    roots = {r.node: r.root for r in common.components(edges).collect()}
    got = {x: roots.get(signed(x), signed(x)) for x in prints}
    own = {x: x for x in prints}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                own[find(a)] = find(b)
    same = lambda f: {frozenset(x for x in prints if f(x) == c) for c in map(f, prints)}
    assert same(got.get) == same(find)


def test_thresholds_obey_the_pigeonhole():
    for n in (10, 10**5, 10**8, 10**11):
        together = np.outer(np.full(64, 0.5), np.full(64, 0.5)) * n
        np.fill_diagonal(together, 0.5 * n)
        for radius in (0, 1, 4, 8):
            plan = simhash.allocate(n, together, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1 and len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)


def test_near_duplicates_leave_one(spark, docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 100 in ids and 101 not in ids and ids.count(107) == 1 and {103, 104, 105} & set(ids) == {103}


def test_components_of_paths_and_stars(spark):
    path, star = [(k, k + 1) for k in range(100, 160)], [(0, k) for k in range(1, 60)]
    out = common.components(spark.createDataFrame([*path, *star, (5, 5)], "a long, b long")).collect()
    assert {(r.node, r.root) for r in out} == {(k, 100) for k in range(101, 161)} | {(k, 0) for k in range(1, 60)}


# 9

def test_codes_give_random_access():
    rng = np.random.default_rng(2)
    for high in (2, 200, 300, 60_000, 1 << 31):
        counts = rng.integers(1, 700, 12)
        ids = rng.integers(0, high, counts.sum()) >> rng.integers(0, 16, counts.sum())
        own = tokenfile.Reader(tokenfile.to_bytes([None, *range(11)], counts, ids))
        assert [own[int(k)] for k in rng.integers(0, len(ids), 300)] is not None and all(own[k] == ids[k] for k in range(0, len(ids), 7))
        assert own.tokens(0, len(ids)).tolist() == ids.tolist() and own.tokens(5, 5).tolist() == []
        ends = np.cumsum(counts)
        assert all(own.document(k).tolist() == ids[ends[k] - counts[k] : ends[k]].tolist() for k in range(12)) and own.nulls.tolist() == [1] + [0] * 11


def test_token_files_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    file = encoder.public_file("word_bpe_49k.json")
    path = common.new_path(spark, "tokens")
    manifest = tokenfile.written(docs, path, file, shard_tokens=500)
    assert manifest.count() > 3
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.summaries(manifest, path).collect()))
    own, at, want = Tokenizer.from_file(file), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert sum(len(r.tokens) for r in tokenfile.token_lists(manifest, path).collect()) == at


# 10

def test_discriminant_separates_and_is_calibrated():
    rng = np.random.default_rng(4)
    n = 400
    y = (rng.random(n) < 0.8).astype(np.int64)
    x = rng.normal(0, 1, (n, len(qda.FEATURES))) * np.where(y[:, None] == 1, 0.5, 2.0) + y[:, None]
    model = qda.fit(x, y)
    score = model.score(x)
    assert ((score >= 0.5) == y).mean() > 0.97 and abs(score.mean() - y.mean()) < 0.03
    assert qda.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and qda.fit(x[y == 1], y[y == 1]).score(x[:1]).tolist() == [1.0]


def test_statistics_of_blank_texts_are_zero():
    assert not qda.statistics(None).any() and not qda.statistics(" \n").any() and np.isfinite(qda.statistics("A! | 3 x x\nx")).all()
