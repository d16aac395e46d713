"""Each operator against its library, brute force or an exact round trip, and on awkward rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import gif_media as G
from tidemark.llm import line_dedup, mixing, ngram_join, resampling, sentencepiece_scan, token_counts, token_orc, toxicity, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\n", "one", "two words", "\x00 nul\x00", "ÀÉ ß Σς İ 中文字 🎉👨‍👩‍👧", "a\t b\r\n c\x1cd\x85e　f", "<|endoftext|> x<|startoftext|>", "x" * 3000, "ab " * 5000, "it's we'll 've  double  spaces "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", i) for i, t in enumerate(ODD_TEXTS)] + [(3, "\n\n", "n", 3), (None, "null id", None, 0)]
    # column names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int").withColumn("id", F.lit(1)).withColumn("size", F.lit("x"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def lower(words):
    return [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in words]


def test_token_counts_match_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    random.seed(1)
    letters = [*"aabbchiÇÀé́ßΣσςİ中字123 \n\t\x1c\x85 'sStTrRe|<>.,!🎉", "<|endoftext|>", "'ll", "aaaa"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + [t or "" for t in ODD_TEXTS]
    assert token_counts.TokenCounter(path).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = token_counts.token_counts(odd, path).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert any(r.over_limit for r in rows) and token_counts.token_counts(empty, path).count() == 0


def brute_components(sets, num, den):
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def near_copies(seed, n=120):
    """Families of edited copies, many of them just under and over the bound, and unrelated texts with a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(n // 5):
            own = [word() if rng.random() < rng.choice([0, 0.005, 0.02, 0.05, 0.15]) else w for w in base]
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(n // 5)]
    return texts + ["Same Text", "same text", "", None, "a b c", "A b c d", texts[0]]


@pytest.mark.parametrize(("width", "similarity"), [(4, (85, 100)), (5, (80, 100))])
def test_ngram_components_match_brute_force(spark, width, similarity, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 8)  # so that groups, tiles and parts are several
    monkeypatch.setattr(ngram_join, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", 6)
    monkeypatch.setattr(ngram_join, "MATRIX_ROWS", 5)
    texts = near_copies(width)
    sets = {}
    for i, t in enumerate(texts):
        w = lower(WORD.findall(t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.ngram_components(df, width, similarity).collect()}
    want = brute_components(sets, *similarity)
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert len(set(want.values())) < len(want) - 10


def test_signatures_never_miss():
    rng = np.random.default_rng(1)
    seen = 0
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 8 + 2)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        union = len(a) + len(b) - common
        if common < union and 100 * common >= 85 * union:
            seen += 1
            assert len(np.intersect1d(ngram_join.signatures(a, 85, 100), ngram_join.signatures(b, 85, 100)))
    assert seen > 200


def test_ngram_awkward_rows(spark, odd, empty):
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.n_shingles == 0} >= {0, 1, 2, 3}
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.one_of_each(odd, ngram_join.ngram_components(odd))
    assert kept.columns == odd.columns
    with pytest.raises(ValueError, match="similarity"):
        ngram_join.ngram_components(odd, similarity=(1, 2))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiorstnl") for _ in range(rng.randint(3, 8)))
    bad = ["zanquor", "bixelud", "frumpig"]
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), bad


def test_toxicity_held_out(spark, labelled):
    docs, bad = labelled
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs, model).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert ((held.score >= 0.3) == (held.toxic == 1)).mean() > 0.97
    reader = toxicity.Reader(model.landmarks)
    score = lambda texts: model.probability(reader.read(pa.array(texts, pa.string())).astype(float))
    gapped = ["nice day zanqxuor tree leaf", "a bi.xelud here and there", "oh f r u m p i g now", "b-i-x-e-l-u-d stone"]
    assert (score(gapped) >= 0.3).all()
    assert (score(["nice day tree leaf stone", "", None]) < 0.3).all()
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("toxic = 1").count() < 10 and kept.where("toxic = 0").count() > 690


def test_subsequence_kernel_by_definition():
    """The kernel against its sum over index tuples."""
    from itertools import combinations

    def slow(s, t, p, d):
        total = 0.0
        for a in combinations(range(len(s)), p):
            for b in combinations(range(len(t)), p):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += d ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    rng = np.random.default_rng(1)
    s, t = rng.integers(1, 4, (20, 7)).astype(np.int16), rng.integers(1, 4, (20, 6)).astype(np.int16)
    for p, d in ((3, 0.6), (4, 0.8), (2, 0.9)):
        got = toxicity.kernel(s, t, p, d)
        assert np.allclose(got, [slow(a.tolist(), b.tolist(), p, d) for a, b in zip(s, t, strict=True)])


def test_toxicity_score_by_definition():
    """Whole scores from the kernel's definition: every string of a text against every landmark, without any short cut."""
    from itertools import combinations

    def k(s, t, p=toxicity.ORDER, d=toxicity.DECAY):
        where = defaultdict(float)
        for a in combinations(range(len(s)), p):
            where["".join(s[i] for i in a)] += d ** (a[-1] - a[0] + 1)
        other = defaultdict(float)
        for b in combinations(range(len(t)), p):
            other["".join(t[i] for i in b)] += d ** (b[-1] - b[0] + 1)
        return sum(v * other[w] for w, v in where.items())

    marks = ["zanquor", "bixel", "frumpig", "aaaab"]
    letters = set("^" + "".join(marks))
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(marks, rng.normal(size=8), -0.3, 1.2, 0.1)
    texts = ["the zanquor and a bixxel", "f r u m p i g said aaaaab", "", None, "zanzanquor zanquorb bi.xel  FRUMPY", "plain words only", "caaaab " * 5]
    want = []
    for text in texts:
        strings = toxicity.Reader.spelled((text or "").lower()) + (text or "").lower().split()
        values = np.zeros((max(1, len(strings)), 4))
        for i, w in enumerate(strings):
            w = "".join(c if c in letters else f"{chr(0x100 + j)}" for j, c in enumerate("^" + w))  # letters of no landmark match nothing
            for j, m in enumerate(marks):
                own = k(w, "^" + m)
                norm = sum(x * x for x in _weights(w, toxicity.ORDER, toxicity.DECAY, letters).values())
                values[i, j] = (own / np.sqrt(norm * k("^" + m, "^" + m))) ** 3 if own else 0
        total = values.sum(axis=0) * toxicity.SUM_SCALE / np.sqrt(len(strings) + toxicity.SUM_WORDS)
        want.append(model.probability(np.concatenate([values.max(axis=0), total])[None])[0])
    got = model.probability(toxicity.Reader(marks).read(pa.array(texts, pa.string())).astype(float))
    assert np.allclose(got, want, atol=1e-5)


def _weights(s, p, d, letters):
    """The kernel's feature vector of a string, over letters that a landmark has."""
    from itertools import combinations

    out = defaultdict(float)
    for a in combinations(range(len(s)), p):
        word = "".join(s[i] for i in a)
        if set(word) <= letters:
            out[word] += d ** (a[-1] - a[0] + 1)
    return out


def test_toxicity_awkward_rows(spark, odd, empty, labelled):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = toxicity.toxicity(odd, none).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxicity(empty, none).count() == 0
    same = toxicity.toxicity(odd, labelled[0].select("doc_id", "toxic")).where("doc_id = 3").collect()
    assert len({r.score for r in same}) == 1


def test_mix(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mixing.mix_sources(docs).toPandas(), mixing.mix_sources(docs.repartition(7)).toPandas()
    assert dict(zip(a.doc_id, a.taken, strict=True)) == dict(zip(b.doc_id, b.taken, strict=True))
    assert (a.taken <= 3 * a["size"]).all() and abs(a.groupby(a.source.fillna("~")).target.first().sum() - a["size"].sum()) < 1e-6
    sums = a.groupby(a.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 0.01 * sums.target + 40).all()
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(empty).count() == 0
    again = mixing.repeat_by_taken(docs, mixing.mix_sources(docs))
    assert again.columns == docs.columns and abs(again.count() - (a.taken / a["size"].clip(lower=1)).sum() - (a["size"] == 0).sum()) < 10
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def slow_repeats(texts, least):
    seen, near, drop = set(), defaultdict(set), set()
    for i, t in texts:
        for k, l in enumerate((t or "").split("\n")):
            w = tuple(lower(WORD.findall(l)))
            if not w:
                continue
            if w in seen:
                drop.add((i, k))
                continue
            seen.add(w)
            if len(w) >= least:
                variants = [w] + [w[:p] + w[p + 1 :] for p in range(len(w))]
                found = {o for v in variants for o in near[v] if line_dedup.within_one_edit(np.array([hash(x) for x in w]), np.array([hash(x) for x in o]))}
                if found:
                    drop.add((i, k))
                for v in variants:
                    near[v].add(w)
    return drop


def test_line_dedup(spark, odd, empty):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(rng.choice([3, 9, 10, 11, 15, 60]))] for _ in range(40)]
    texts = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                w[p : p + rng.choice([0, 1])] = rng.choice([[], ["new"], ["z" * rng.randint(1, 4)]])
                w = w or ["x"]
            lines.append(rng.choice([" ".join(w), "  ".join(w).upper(), ""]))
        texts.append((i, "\n".join(lines)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = slow_repeats(texts, line_dedup.WORDS_PER_EDIT)
    assert {tuple(r) for r in line_dedup.repeated_lines(df).collect()} == want and len(want) > 100
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for i, t in texts:
        assert got[i].text == "\n".join(l for k, l in enumerate(t.split("\n")) if (i, k) not in want) or not t
        assert got[i].n_dropped == sum(d == i for d, _ in want)
    out = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")))
    assert out.count() == odd.count() and out.where("doc_id = 0 AND text IS NULL").count() == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_token_orc(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(2)
    letters = [*"aabbchiÇÀé́ß中字123 \n\t\x1c\x1f\x85   'sStTrRe|<>.,!🎉\x00", "<|endoftext|>", "'ll", "aaaa", " "]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [t or "" for t in ODD_TEXTS]
    encoder = token_orc.UnitEncoder(path)
    got = [i[a:b].tolist() for i, bounds in encoder.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    where = f"file://{tmp_path}/tokens"
    rows = token_orc.token_orc_roundtrip(docs, path, where).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, ODD_TEXTS, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert token_orc.lookup_tokens(spark, where, [5]).count() == 1
    assert token_orc.read_token_orc(spark, where).where("doc_id = 5").first().ids[-1] == 0
    plan = token_orc.lookup_tokens(spark, where, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan
    assert token_orc.token_orc_roundtrip(empty, path).count() == 0 and token_orc.token_orc_roundtrip(odd, path).count() == odd.count()


def test_sentencepiece_matches_library(spark, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_scan.Pieces(path)
    encoder = sentencepiece_scan.PieceEncoder(model)
    random.seed(3)
    letters = [*"aabbchiÇÀé́ßσ中文字梦123  \n\t'sStTrRe|<>.,!🎉▁", "the", "ing", "aaaa", "    "]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    ids, bounds = encoder.encode_texts(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode(texts)
    assert [encoder.encode_one(sentencepiece_scan.prepared(t)).tolist() for t in texts[:300]] == library.encode(texts[:300])
    assert [model.decode(np.array(i, dtype=np.int64)) for i in library.encode(texts)] == library.decode(library.encode(texts))

    long = ["".join(random.choice(["the", "in", "ation", "qu", "er", "s", "xz", " ", "  "]) for _ in range(300)), "".join(random.choice(["the", "ing", "x"]) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(long + [long[0]] + ["short one", None, ""])), "doc_id long, text string")
    for chunk in (17, 50, 333):
        rows = {r.doc_id: r for r in sentencepiece_scan.encode_pieces(docs, path, chunk=chunk).collect()}
        assert all(rows[i].ids == library.encode(t or "") for i, t in enumerate(long + [long[0]] + ["short one", None, ""]))
    assert sentencepiece_scan.pieces_digest(sentencepiece_scan.encode_pieces(docs, path), path).where("restored").count() == 6
    assert sentencepiece_scan.decode_pieces(sentencepiece_scan.encode_pieces(docs, path), path).where("doc_id = 3").first().decoded == "short one"
    assert sentencepiece_scan.encode_pieces(odd, path).count() == odd.count() and sentencepiece_scan.encode_pieces(empty, path).count() == 0


def test_scan_up_and_down_the_tree():
    """States from the tree of products are those of the whole text's path, for any number of chunks."""
    model = sentencepiece_scan.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = sentencepiece_scan.prepared("thequickbrownfoxinternationalizationjumpsover thelazydog and more of it")
    at, edges = 0, {0}
    for piece in model.trace(text):
        at += len(piece)
        edges.add(at)
    for size in (5, 9, 13, 40, 200):
        starts = range(0, len(text), size)
        m = [sentencepiece_scan.transfer(model, text[i : i + size + model.longest], min(size, len(text) - i), i + size >= len(text)) for i in starts]
        states = sentencepiece_scan.scan_states(model, m)
        assert len(states) == len(m) + 1 and states[0] == states[-1] == 0
        assert all(i + s in edges for i, s in zip(starts, states[:-1], strict=True))


def test_transfer_matrices_combine_associatively():
    model = sentencepiece_scan.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = sentencepiece_scan.prepared("thequickbrownfoxinternationalizationjumpsoverthelazydog and more")
    size = 13
    at = list(range(0, len(text), size))
    m = [sentencepiece_scan.transfer(model, text[i : i + size + model.longest], min(size, len(text) - i), i + size >= len(text)) for i in at]
    left = sentencepiece_scan.combine(model, sentencepiece_scan.combine(model, m[0], m[1]), m[2])
    right = sentencepiece_scan.combine(model, m[0], sentencepiece_scan.combine(model, m[1], m[2]))
    assert sorted(left) == sorted(right)


def slow_nearest(frame, every, k):
    v = {i: np.array(x, dtype=float) for i, x in frame if x is not None and len(x) and None not in x and np.isfinite(np.array(x, dtype=float)).all() and np.any(np.array(x, dtype=float))}
    out = {}
    for q in v:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q].tolist(), x.tolist(), strict=True)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1500)] + [(1500 + i, [1.0] * 8) for i in range(300)]
    rows += [(1800, None), (1820, []), (1840, [0.0] * 8), (1860, [float("nan")] * 8), (1880, [1.0, None]), (1900, [1.0, 2.0]), (1901, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = slow_nearest(rows, 20, 20)
    got = defaultdict(list)
    for r in vptree.nearest_inner_products(df, shard_rows=300, query_rows=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want
    loose = defaultdict(set)
    for r in vptree.nearest_inner_products(df, factor=1.5, shard_rows=300).collect():
        loose[r.query_id].add(r.vec_id)
    found = sum(len(set(want[q]) & loose[q]) for q in want) / sum(map(len, want.values()))
    assert 0.5 < found <= 1  # vectors without any structure
    assert vptree.nearest_inner_products(df.where("false")).count() == 0


def test_vector_search_by_any_norms(spark):
    """Norms over six decades, equal vectors, repeated ids, clashing columns: factor 1 stays exact."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1200, 6)) * 10.0 ** rng.integers(-3, 4, 1200)[:, None]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(base)] + [(2000 + i, base[7].tolist(), 2, "y") for i in range(200)]
    df = spark.createDataFrame(rows + [(40, base[40].tolist(), 3, "z")], "vec_id long, embedding array<double>, dim int, query_id string").withColumn("shard", F.lit(1))
    want = slow_nearest([(r[0], r[1]) for r in rows], 20, 20)
    got = defaultdict(list)
    for r in vptree.nearest_inner_products(df, shard_rows=200, query_rows=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want


def test_vector_search_relaxed(spark):
    """On vectors in clusters a relaxed factor keeps nine in ten neighbours or more."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    points = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = slow_nearest(rows, 60, 10)
    loose = defaultdict(set)
    for r in vptree.nearest_inner_products(df, query_every=60, k=10, factor=1.3, shard_rows=500).collect():
        loose[r.query_id].add(r.vec_id)
    assert sum(len(set(want[q]) & loose[q]) for q in want) / sum(map(len, want.values())) >= 0.9


def test_search_prunes():
    """Most leaves of clustered points stay shut, and what is found is exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 20
    points = centres[np.arange(4000) % 40] + rng.normal(size=(4000, 8))
    seen = []

    class Counting(vptree.Search):
        def _scan(self, rows, active):
            seen.append(len(rows) * len(active))
            super()._scan(rows, active)

    queries = points[::100]
    s = Counting(points, np.arange(4000), queries, np.arange(0, 4000, 100), np.full(40, -np.inf), 5, 1.0)
    s.visit(vptree.build_tree(points, leaf=64), np.arange(40))
    exact = queries @ points.T
    exact[np.arange(40), np.arange(0, 4000, 100)] = -np.inf
    assert (np.sort(s.row, axis=1) == np.sort(np.argsort(-exact, axis=1)[:, :5], axis=1)).all()
    assert sum(seen) < 0.6 * 40 * 4000


def slow_gif(data):
    """The shown canvases of a file of full-width, non-interlaced images with one palette: a decoder that shares nothing with the operator's."""
    width, height = data[6] | data[7] << 8, data[8] | data[9] << 8
    at = 13 + 3 * 256
    canvas, shown, clear = [0] * (width * height), [], None
    while data[at] != 0x3B:
        if data[at] == 0x21 and data[at + 1] == 0xF9:
            clear = data[at + 6] if data[at + 3] & 1 else None
            at += 8
        elif data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        else:
            rows, bits = data[at + 7] | data[at + 8] << 8, data[at + 10]
            at += 11
            body = b""
            while data[at]:
                body += data[at + 1 : at + 1 + data[at]]
                at += data[at] + 1
            at += 1
            value = int.from_bytes(body, "little")
            samples, table, size, last, pos = [], [], bits + 1, None, 0
            while True:
                code = value >> pos & (1 << size) - 1
                pos += size
                if code == 1 << bits:
                    table, size, last = [[i] for i in range(1 << bits)] + [[], []], bits + 1, None
                    continue
                if code == (1 << bits) + 1:
                    break
                word = table[code] if code < len(table) else last + last[:1]
                samples += word
                if last is not None and len(table) < 4096:
                    table.append(last + word[:1])
                last = word
                size = min(12, max(bits + 1, len(table).bit_length()))
            for i, x in enumerate(samples):
                if x != clear:
                    canvas[i] = x
            shown.append((rows, list(canvas)))
    return width, shown


def test_gif_against_another_decoder():
    rng = random.Random(8)
    for n in (64, 640, 64 * 30):
        raw = bytes(rng.choice(b"abc \n\xc3\xa9") for _ in range(n))
        data = G.encode_gif(raw, frame_rows=7)
        width, shown = slow_gif(data)
        assert b"".join(bytes(c[: rows * width]) for rows, c in shown) == raw
        assert [c for _, c in shown] == [(c & 255).ravel().tolist() for c in (x.copy() for x in G.compose(G.parse_gif(data)))]
    assert any(f.transparent == G.CLEAR for f in G.parse_gif(G.encode_gif(b"a" * 1280, frame_rows=7)).frames)
    assert all(f.transparent is None for f in G.parse_gif(G.encode_gif(b"\xff" * 1280, frame_rows=7)).frames)


def test_gif_survives_any_bytes(spark):
    rng = random.Random(9)
    good = G.encode_gif(bytes(range(64)) * 4)
    files = [good[:n] for n in range(0, len(good), 29)] + [bytes(rng.randrange(256) for _ in range(60)) for _ in range(40)]
    for _ in range(150):
        broken = bytearray(good)
        for _ in range(rng.choice([1, 3, 10])):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        files.append(bytes(broken))
    at = good.index(b"\x2c", 800)
    huge = bytearray(good)
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    coded = bytearray(good)
    coded[at + 10] = 200
    files += [bytes(huge), bytes(coded), None]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    got = G.decode_media(df).select("doc_id").distinct().count()
    assert 0 < got < len(files)
    assert G.decode_media(df.where(F.col("doc_id") >= len(files) - 3)).count() == 0
    nothing = G.media_digest(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()
    assert nothing.payload_sha256 is None and nothing.frames is None


def test_gif_round_trips():
    rng = random.Random(1)
    for _ in range(60):
        raw = bytes(rng.choice([0, 1, 255, rng.randrange(256)]) for _ in range(rng.choice([1, 5, 64, 6400, 30000])))
        assert G.lzw_decode(G.lzw_encode(raw), 8) == raw
    for bits in (2, 4, 7):
        raw = bytes(rng.randrange(1 << bits) for _ in range(5000))
        assert G.lzw_decode(G.lzw_encode(raw, bits), bits) == raw
    assert G.lzw_decode(G.lzw_encode(b""), 8) == b""
    gif = G.parse_gif(G.encode_gif(bytes(range(256)) * 300))
    assert b"".join(f.indices.tobytes() for f in gif.frames) == bytes(range(256)) * 300 and len(gif.frames) == 2


def handmade(frames, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff", width=2, height=2):
    import struct

    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), palette]
    for left, top, w, h, samples, disposal, transparent, delay, interlaced in frames:
        packed = disposal << 2 | (transparent is not None)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, transparent or 0) + b"\0")
        stream = G.lzw_encode(bytes(samples), 2)
        parts.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0) + b"\x02" + bytes([len(stream)]) + stream + b"\0")
    return b"".join([*parts, b"\x3b"])


def test_gif_disposal_and_transparency(spark):
    red, green, blue = 0xFF0000, 0x00FF00, 0x0000FF
    data = handmade([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, False), (0, 0, 2, 1, [2, 0], 3, 0, 7, False), (1, 1, 1, 1, [3], 2, None, 9, False), (0, 0, 1, 1, [2], 0, None, 1, False)])
    shown = [c.copy().tolist() for c in G.compose(G.parse_gif(data))]
    assert shown[0] == [[red, red], [red, red]]
    assert shown[1] == [[green, red], [red, red]]  # 0 is transparent; the frame is undone afterwards
    assert shown[2] == [[red, red], [red, blue]]  # this one's place is cleared afterwards
    assert shown[3] == [[green, red], [red, 0]]
    rows = G.decode_media(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")).orderBy("frame").collect()
    assert [(r.frame, r.start_cs, r.delay_cs) for r in rows] == [(0, 0, 5), (1, 5, 7), (2, 12, 9), (3, 21, 1)] and all(sum(r.histogram) == 4 for r in rows)
    straight = G.parse_gif(handmade([(0, 0, 1, 5, [0, 2, 1, 3, 1], 0, None, 0, True)], width=1, height=5)).frames[0].indices.ravel().tolist()
    assert straight == [0, 3, 1, 1, 2]  # rows 0, 4, 2, 1, 3 as stored
    with pytest.raises(ValueError, match="GIF"):
        G.parse_gif(b"PNG")


def test_text_media(spark, odd, empty):
    import hashlib

    rows = {r.doc_id: r for r in G.text_media_roundtrip(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    for i, t in enumerate(ODD_TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[0].feature == rows[1].feature
    assert rows[0].frames[0].delay_cs == G.DELAY_CS and sum(rows[0].frames[0].histogram) == 64
    everything = G.text_media_roundtrip(odd)
    assert everything.count() == odd.count() and everything.where("doc_id IS NULL").count() == 1 and everything.where("doc_id = 3").count() == 2
    assert G.text_media_roundtrip(empty).count() == 0


def test_resampling(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "clear", "text"] if i % 3 else ["%%%", "$$$", "junk"]) for _ in range(rng.randint(1, 80)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = docs.where("doc_id % 3 <> 0 AND doc_id < 300").select("doc_id")
    got = resampling.resample(docs, good, fraction=0.5).toPandas()
    assert got.selected.sum() == 450 and not got[got.doc_id % 3 == 0].selected.any()
    again = resampling.resample(docs.repartition(5), good, fraction=0.5).toPandas()
    assert dict(zip(got.doc_id, got.selected, strict=True)) == dict(zip(again.doc_id, again.selected, strict=True))
    cut = got[got.selected].gumbel_key.min()
    assert (got[~got.selected].gumbel_key < cut).all()
    assert resampling.resample(odd, good).count() == odd.count() and resampling.resample(empty, good).count() == 0
    assert resampling.resample(odd, good.where("false")).where("doc_id = 1").first().score == 0


def test_importance_by_definition(spark):
    """Log ratios summed over words and pairs of neighbours, from dictionaries of n-grams instead of buckets."""
    texts = ["good fine text", "junk junk %%%", "fine", "", None, "Good  good\ntext fine", "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = spark.createDataFrame([(0,), (5,)], "doc_id long")
    grams = [lower(WORD.findall(t or "")) for t in texts]
    grams = [w + [f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)] for w in grams]
    raw, target = defaultdict(int), defaultdict(int)
    for i, g in enumerate(grams):
        for x in g:
            raw[x] += 1
            target[x] += i in (0, 5)
    # Few enough n-grams that none share a bucket.
    n, total = sum(raw.values()), sum(target.values())
    want = [sum(np.log((target[x] + resampling.PRIOR * raw[x] / n) / (total + resampling.PRIOR) / (raw[x] / n)) for x in g) for g in grams]
    got = {r.doc_id: r for r in resampling.resample(docs, good).collect()}
    assert np.allclose([got[i].score for i in range(len(texts))], want)
    assert [got[i].n_ngrams for i in range(len(texts))] == [len(g) for g in grams]
    assert np.allclose([got[i].mean_score for i in range(len(texts))], [w / max(1, len(g)) for w, g in zip(want, grams, strict=True)])


def test_windows_of_long_texts(monkeypatch):
    """Hashes and n-grams do not depend on where windows fall."""
    from tidemark.llm import shared

    rng = random.Random(6)
    block = [("".join(rng.choice("abcDE  \n") for _ in range(n)) + "é").encode() for n in (0, 5, 300, 2000, 17, 900)] + [b"", b"x" * 700, b" "]
    words, bounds = shared.hash_words(block)
    shingles, at = shared.hash_shingles(words, bounds, 4)
    lines = shared.hash_lines(block)
    grams = [np.concatenate(x) for x in zip(*[(s, p) for _, s, p, _ in resampling._windows(block, 1 << 14)], strict=True)]
    monkeypatch.setattr(shared, "WINDOW_BYTES", 64)
    monkeypatch.setattr(shared, "WINDOW_WORDS", 7)
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 11)
    again, same = shared.hash_words(block)
    assert (again == words).all() and (same == bounds).all()
    assert (shared.hash_shingles(words, bounds, 4)[0] == shingles).all() and (shared.hash_shingles(words, bounds, 4)[1] == at).all()
    assert all((a == b).all() for a, b in zip(shared.hash_lines(block), lines, strict=True))
    assert all((a == b).all() for a, b in zip([np.concatenate(x) for x in zip(*[(s, p) for _, s, p, _ in resampling._windows(block, 1 << 14)], strict=True)], grams, strict=True))
    assert len(words) == sum(len(re.findall(rb"[^\x20\x09-\x0D]+", b)) for b in block)


def test_texts_beyond_every_block(spark):
    """A text of 5 MiB through the counters and encoders, against the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeÉ中") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(700_000)) + "\n" + "x" * 3000
    assert len(long.encode()) > 5 << 20
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.TokenCounter(path).count([long, "a"])[0] == len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    (ids, bounds), *_ = token_orc.UnitEncoder(path).encode(pa.array([long]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert sentencepiece_scan.encode_pieces(docs, path).first().ids == sentencepiece.SentencePieceProcessor(model_file=path).encode(long)
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, long.replace("x" * 3000, "y z"))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1] and got[1].text == "y z"
    assert len({r.component_id for r in ngram_join.ngram_components(docs.union(docs.selectExpr("2L", "concat(text, ' end')"))).collect()}) == 1


def test_gumbel_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BINS", 16)
    scored = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score"))
    for fraction in (0.0, 0.1, 0.5, 1.0):
        got = resampling.gumbel_top(scored, fraction).toPandas()
        assert got.selected.sum() == int(np.ceil(3000 * fraction))
        if 0 < fraction < 1:
            assert got[got.selected].gumbel_key.min() > got[~got.selected].gumbel_key.max()
    tied = resampling.gumbel_top(spark.createDataFrame([(i, float(i == 3)) for i in [1, 1, 2, 3]], "doc_id long, score double"), 0.5)
    assert tied.count() == 4


def test_bigram_counts():
    from tidemark.llm.shared import hash_words

    words, bounds = hash_words([b"A b a", b"", b"b"])
    single, pair = resampling.bucket_ngrams(words, bounds, 1 << 14)
    assert single[0] == single[2] and single[1] == single[3] and (pair < 0).tolist() == [False, False, True, True] and pair[0] != pair[1]


def test_units_with_and_without_a_space_before_them():
    encoder = token_orc.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    units = [" plain", "bare", " 's", " a,b", "x", " é7!", " Ġ", "Ġq", " don't"]
    for some in (units, units[::-1], [u for u in units if u[0] == " "], [u for u in units if u[0] != " "], [*units, " two  spaces"]):
        flat, sizes = encoder._ids(some)
        want = [encoder.tokenizer.encode(u, add_special_tokens=False).ids for u in some]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert encoder._spaced([" one", " two"])[1].tolist() == [1, 1] and encoder._spaced([" two  spaces"]) is None


def test_words_are_encoded_once_whatever_sign_follows(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, encoder = random.Random(8), token_orc.UnitEncoder(path)
    words = ["the", "don't", "dogs'", "l'été", "Straße", "x", "naïve", "1,000", "12", "a.b", "3×", "日本", "é", "🙂", "<|endoftext|", "<|endoftext|>", "a<|endoftext|>", "'", "''s", "ÿ", "÷", "ǆ", "​", "it's", "I'LL"]
    tails = ["", ",", ".", "...", "***", "!?", "'", "',", ",'s", "'s,", ">", "|>", "#1", "§", "_", "-", '"', ")."]
    texts = [" ".join(rng.choice(words) + rng.choice(tails) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["\n".join(rng.sample(words, 3)) + "," for _ in range(30)]
    texts += [None, "", " ", ",", "a,", " a,", "a,  b.", "a,\tb.\n", "<|endoftext|>,", "a, "]
    for some in (texts, [None, " "], [","], ["a\t"], []):
        got = [ids[a:b].tolist() for ids, bounds in encoder.encode(pa.array(some, pa.string())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    learned, ids = [], token_orc.UnitEncoder._ids
    monkeypatch.setattr(token_orc.UnitEncoder, "_ids", lambda self, units: learned.extend(units) or ids(self, units))
    list(token_orc.UnitEncoder(path).encode(pa.array([f"word{a} word{b} word" for a in tails[1:6] for b in tails[1:6]])))
    assert sorted(learned) == sorted([" word", "word", *tails[1:6]])
