import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann, bpe, chunks, components, langid, line_dedup, mixing, ngram_join, pii, stream_dedup, token_files, toxicity
from spanloom.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, set string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Near and exact copies, a common passage, nulls, empty, short and long texts, repeated rows, clashing columns."""
    rnd = random.Random(4)
    passage = text(rnd, 60)
    texts = [text(rnd, rnd.randint(1, 200)) for _ in range(60)]
    family = text(rnd, 120)
    for _ in range(40):
        w = family.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 99))
        texts.append(" ".join(w))
    texts += [passage + "\n" + text(rnd, rnd.randint(5, 60)) for _ in range(40)]
    texts += [texts[0].upper(), texts[0] + " ", texts[1], None, None, "", "  \n ", "one two", "ONE two", "x " * 30_000, " a\x1cb Σ İ", "a\nb\nc\nd\na\nb\nc", "mail x.y@z.com a +1 (234) 555-0100 b 4111 1111 1111 1111 c 1.2.3.4"]
    out = [(i, t, "en", rnd.choice(["s0", "s0", "s1", None, "é"]), 0, "x", "y") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (5, "another text for a used id", None, "s1", 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_ngram_join(docs, rows):
    unique = {(r[0], r[1]) for r in rows if r[0] != 5}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs.where("doc_id != 5")).collect()}
    ids, sets = zip(*[(i, shingle_set(t)) for i, t in unique])
    group = {i: {i} for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]) and group[ids[a]] is not group[ids[b]]:
                group[ids[a]] |= group[ids[b]]
                for x in group[ids[b]]:
                    group[x] = group[ids[a]]
    assert got == {i: (len(s), min(group[i])) for i, s in zip(ids, sets)}
    assert ngram_join.join(docs).count() == len(rows)


def test_signatures_share_enough():
    rnd = np.random.default_rng(1)
    for size in (2, 5, 9, 15, 16, 40, 300):
        for _ in range(60):
            s = np.unique(rnd.integers(0, 2**64, size, np.uint64))
            t = np.unique(np.concatenate([rnd.permutation(s)[: max(1, size - rnd.integers(0, size // 5 + 1))], rnd.integers(0, 2**64, rnd.integers(0, size // 6 + 1), np.uint64)]))
            if 100 * len(np.intersect1d(s, t)) < 75 * len(np.union1d(s, t)):
                continue
            band = max(len(s), len(t)).bit_length() - 1
            (x, e), (y, g) = ngram_join.signatures(s, band), ngram_join.signatures(t, band)
            assert band in ngram_join.bands(len(s)) and band in ngram_join.bands(len(t))
            assert len(np.intersect1d(x, y)) >= max(ngram_join.shared_least(len(s), band) - e, ngram_join.shared_least(len(t), band) - g)


def test_mixing(docs, rows):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert sum(r.size for r in v) == v[0].source_size and v[0].target <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= 1 + 0.02 * v[0].target
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(5)).collect()))


def test_mix_is_shuffled_within_shards(spark):
    rnd = random.Random(11)
    many = spark.createDataFrame([(i, text(rnd, rnd.randint(1, 60)), rnd.choice("abc")) for i in range(400)], "doc_id long, text string, source string").repartition(3)
    got = mixing.query(many).collect()
    assert all(len(r.shards) == len(r.places) for r in got)
    slots = sorted((s, p, r.doc_id) for r in got for s, p in zip(r.shards, r.places))
    assert len({s for s, *_ in slots}) == 8
    order = [r.doc_id for r in mixing.mixed(many).collect()]
    assert order == [i for *_, i in slots]
    assert order == [r.doc_id for r in mixing.mixed(many.repartition(7)).collect()]


def test_ann(spark):
    rnd = np.random.default_rng(3)
    vec = [(i, [float(x) for x in rnd.standard_normal(16)]) for i in range(700)]
    vec += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0]), (780, [None] * 16)]
    e = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in vec[:700]])
    v = ann.usable(e)
    got = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0"), block=200, sample=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    found = 0
    for q, best in got.items():
        s = x @ x[q]
        assert all(abs(s[i] - c) < 1e-9 for _, i, c in best) and [r for r, *_ in sorted(best)] == list(range(1, 21))
        s[q] = -np.inf
        found += len(set(np.argsort(-s)[:20]) & {i for _, i, _ in best})
    assert found >= 0.9 * 20 * len(got)
    assert ann.query(e.where("false")).count() == 0


def test_ann_in_one_region_equals_brute_force(spark):
    """A small table is one region, so no query goes to any other; repeated rows and ties are candidates each."""
    rng = np.random.default_rng(2)
    own = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.standard_normal((60, 8)))]
    own += [own[7], own[40], (100, own[7][1]), (101, None), (102, [0.0] * 8), (103, [1.0] * 7 + [None])]
    got = {}
    for r in ann.search(v := ann.usable(spark.createDataFrame(own, "vec_id long, embedding array<double>")), v.where("vec_id % 20 = 0"), stop=1 - 1e-9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, found in got.items():
        x = dict(own)[q]
        order = sorted((-np.dot(x, y), i) for i, y in own if i != q and i < 101)
        assert [i for _, i in sorted(found)] == [i for _, i in order[:20]]
    assert sorted(got) == [0, 20, 40, 100]


def test_pii(docs):
    base = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]
    rnd = random.Random(5)
    for t in ["".join(rnd.choice("a1.@-+ 2(3)é") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]:
        want = []
        for k, p in enumerate(base):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    want.append((m.start(), k, m.end()))
        assert [s for s in pii.spans(t) if s[1] < pii.BASE] == sorted(want)
    got = pii.find(docs).where("n_email > 0").collect()
    assert len(got) == 1 and (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)


def test_exact_dedup(docs, rows, empty):
    got = stream_dedup.dedup(docs).collect()
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = sorted((r[0], max(g := groups[norm(r[1])]), len(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = stream_dedup.keep_first(docs, stream_dedup.dedup(docs))
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert stream_dedup.dedup(empty).count() == 0


def test_stream_goes_on(spark, docs, tmp_path):
    path, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    for part in (docs.where("doc_id < 70"), docs.where("doc_id >= 70")):
        stream_dedup.stage(part, path)
        stream_dedup.consume(spark, path, state, out)
    one = {r.digest: (r.keep_id, r.n) for r in stream_dedup.groups(spark, out).collect()}
    assert one == {r.text_sha256: (r.keep_id, r.group_size) for r in stream_dedup.dedup(docs).collect()}


def test_line_dedup(docs):
    got = {r.doc_id: r for r in line_dedup.dedup(docs.where("text like 'a\nb%'")).collect()}
    (r,) = got.values()
    assert (r.n_lines, r.n_removed, r.text) == (7, 3, "a\nb\nc\nd")
    assert line_dedup.dedup(docs).count() == docs.count()


def test_langid(spark):
    rnd = random.Random(6)
    sound = {"aa": ["ba", "lo", "mi"], "bb": ["kr", "ut", "zeg"], "cc": ["éa", "ñu", "so"]}
    rows = [(i, " ".join("".join(rnd.choice(sound[k]) for _ in range(3)) for _ in range(30)), k) for i in range(120) for k in [list(sound)[i % 3]]]
    rows += [(500, None, "aa"), (501, "123 !!", None), (502, "b" * 500, None), (503, "", "bb")]
    got = {r.doc_id: r for r in langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (500, 501, 503)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert {r.lang_pred for r in langid.query(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_automaton_knows_all_substrings():
    rnd = random.Random(7)
    s = [rnd.randint(0, 2) for _ in range(60)]
    move = langid.suffix_automaton(s)
    has = {tuple(s[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(500):
        t = tuple(rnd.randint(0, 2) for _ in range(rnd.randint(1, 9)))
        state = 0
        for c in t:
            state = move[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == (t in has)


def test_phrases_equal_brute_force():
    rnd = random.Random(3)
    normal = lambda t: f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t.lower()).split())} "

    def brute(t, sample):
        n = at = 0
        while at < len(t):
            end = at + 1
            while end <= len(t) and t[at:end] in sample:
                end += 1
            at, n = max(at + 1, end - 1), n + 1
        return n

    for _ in range(60):
        samples = {k: "".join(rnd.choice("abcé  ") for _ in range(rnd.randint(1, 60))) + "a" for k in "xyz"}
        model = langid.Model(samples)
        texts = [t for t in ("".join(rnd.choice("abcdé ²") for _ in range(rnd.randint(0, 90))) for _ in range(6)) if normal(t).strip()]
        parts = [langid.coded(t, model.codes) for t in texts]
        sizes = np.array([len(p) for p in parts])
        got = model.moves.phrases(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes)
        assert got.T.tolist() == [[brute(normal(t), normal(samples[k])) for k in model.langs] for t in texts]
    assert model.predict(["²½", "", "123"]) == [("und", 0.0)] * 3


def test_the_end_of_a_long_text_decides(spark):
    """Neither the parse nor the sample stops at a prefix; one word may be as long as a text."""
    model = langid.Model({"aa": "balomi " * 50, "bb": "krutzeg " * 50})
    assert [model.predict([t])[0][0] for t in ("zz " * 300 + "balomi " * 9000, "balomi " * 3000 + "krutzeg " * 9000, "balo" * 40 + "krutzeg" * 900)] == ["aa", "bb", "bb"]
    late = [(i, "?! " * 9000 + "krutzeg " * 40 if i % 2 else "balomi " * 40, "bb" if i % 2 else "aa") for i in range(40)]
    got = langid.query(spark.createDataFrame(late, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("bb" if r.doc_id % 2 else "aa") for r in got)


def test_toxicity(spark, docs):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = text(rnd, 60).split()
        for _ in range(3 * bad):
            w.insert(rnd.randrange(len(w)), rnd.choice(["moron", "grubwort", "grubwesen", "grubling"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.query(d, lab).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in labels if i in set(held)) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.query(docs, lab.where("false")).count() == docs.count()


def test_shouting_is_counted_over_the_whole_text():
    shouts = lambda *parts: toxicity.Model().hits(" ".join(w for word, n in parts for w in [word] * n))[2][4]
    assert shouts(("quiet", 500), ("LOUD", 600)) == 1
    assert shouts(("LOUD", 400), ("quiet", 2000)) == 0
    assert shouts(("LOUD", 500), ("quiet", 500)) == 0
    assert shouts(("LOUD", 30), ("quiet", 10)) == 1


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer())
    path = f"{tmp_path}/ids"
    files = token_files.write(docs, path, tokenizer(), 2, 3)
    assert files.agg(F.sum("n_docs")).first()[0] == len(rows)
    at = 0
    for r, row in zip(token_files.read(spark, path).orderBy("doc_id", "start").collect(), sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        ids = [*lib.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (row[0], at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    name = files.orderBy("file").first()["name"]
    fs, base = token_files.store(path)
    want = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    with fs.open_input_file(f"{base}/{name}") as f:
        reader = token_files.Reader(f)
        read_at, seen = reader.file.read_at, []
        reader.file = type("", (), {"read_at": lambda _, n, at: seen.append(n) or read_at(n, at)})()
        assert reader.get(0)[0].tolist() == want(rows[0][1]) and seen == [reader.docs["size"][0]]  # its frame alone
    got = token_files.fetch(spark, path, [5, 77, 10**6])
    assert {k: sorted(x.tolist() for x in v) for k, v in got.items()} == {i: sorted(want(r[1]) for r in rows if r[0] == i) for i in (5, 77)}
    small = token_files.write(docs, f"{path}-small", tokenizer(), 2, 2, most_bytes=2000)
    assert small.count() > 4 and token_files.read(spark, f"{path}-small").drop("ids").exceptAll(token_files.read(spark, path).drop("ids")).isEmpty()
    broken = bytearray(open(f"{path}/{name}", "rb").read())
    broken[3] ^= 1
    open(f"{path}/broken", "wb").write(broken)
    with fs.open_input_file(f"{base}/broken") as f, pytest.raises(ValueError):
        list(token_files.Reader(f).documents())


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    def facts(t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    lib, enc = Tokenizer.from_file(tokenizer()), bpe.encoder(tokenizer())
    rnd = random.Random(9)
    odd = ["".join(rnd.choice("ab eé.'sŚΣİ\x1c\x85漢🙂<|endoftext|>12,!") for _ in range(rnd.randint(0, 40))) for _ in range(1000)]
    odd += ["a" * 4000, "the" * 2000, "!" * 3000, "<|endoftext|>", ""]
    for t in odd:
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids
        d = bpe.Decoder(enc.of)
        parts = [d.text(ids[i : i + 3]) for i in range(0, len(ids), 3)]
        assert "".join(parts) + d.end() == lib.decode(ids, skip_special_tokens=False)
    want = sorted((r[0], *facts(r[1])) for r in rows)
    assert sorted(map(tuple, bpe.digests(docs, tokenizer()).collect())) == want
    d = bpe.Decoder(enc.of, byte_level=True)
    assert d.text([enc.of.ids[c] for c in map(enc.of.symbols.__getitem__, "é".encode())][:1]) == ""


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for got in (ngram_join.join(empty), mixing.query(empty), pii.find(empty), line_dedup.query(empty), langid.query(empty), toxicity.query(empty, labels), token_files.write_and_read(empty, tokenizer()), bpe.digests(empty, tokenizer()), mixing.mixed(empty)):
        assert got.count() == 0


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n // 3, np.uint64)]))
        bits = int(np.bitwise_count((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
        assert not (ngram_join.parity(a) ^ ngram_join.parity(a.copy())).any()


def test_merged_equals_components_from_scratch(spark):
    rng = np.random.default_rng(4)
    first, second = ([(int(a), int(b)) for a, b in rng.integers(0, 120, (60, 2))] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    grown = components.merged(components.components(frame(first)), frame(second))
    whole = components.components(frame(first + second))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))
    groups = components.components(frame(first))
    assert components.merged(groups, frame([])) is groups


def test_families_of_near_copies_equal_brute_force(spark):
    """Buckets above the cap, with similar and hardly dissimilar members."""
    rnd = random.Random(8)
    base, made = text(rnd, 90).split(), []
    for i in range(70):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 12)}"
        made.append((i, " ".join(words)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in made for w in [t.split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    assert 1 < len(set(root.values())) < 60
    got = ngram_join.join(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == root


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["", " lead\ttrail \n", "a\x1cb c", "İ. İ* Aİ,", "क़. ok", "It's 'tis don't--x", "ΣΑΣ ΟΔΟΣ. ςσ", "é ́x", "<|endoftext|> x", "ab12.. x²", "日本語。 ﬁ. ﬀ!", "ok🙂! a‍b"]
    texts += ["".join(rng.choice("aAbé'.,;#*)( \n\t0ΣǅßŉİıÅ中́ \x1f\x85<|") for _ in range(40)) for _ in range(2000)]
    lib = Tokenizer.from_file(tokenizer())
    got = token_files.Library(tokenizer()).encode_many(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_chunks_are_encoded_by_columns(monkeypatch):
    """No Python call for each chunk; results don't depend on groups, on what is remembered or on odd white space."""
    import sys

    from tokenizers import Tokenizer

    lib, own, rnd = Tokenizer.from_file(tokenizer()), token_files.Library(tokenizer()), random.Random(21)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", ".", ",%%"]) for _ in range(8000)]
    texts = [" ".join(rnd.choice(words) for _ in range(500)) for _ in range(60)]
    want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    calls = []
    sys.setprofile(lambda _, kind, __: calls.append(kind))
    try:
        got = list(own.encode_many(texts))
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want and len(calls) < 6000
    monkeypatch.setattr(chunks, "TOGETHER", 20_000)
    monkeypatch.setattr(chunks, "MEMORY", 1000)
    assert list(own.encode_many(texts)) == got and list(token_files.Library(tokenizer()).encode_many(texts)) == got
    spaces = [f"a{c}b {c} x{c} w{c}," for c in map(chr, [*range(0x250), 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF])]
    for t, g in zip(spaces, own.encode_many(spaces), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert list(own.encode_many([])) == [] and list(own.encode_many(["", " \n"])) == [b"", b""]


def test_words_are_encoded_together(monkeypatch):
    """Few look-ups for words that begin alike; results don't depend on groups, stretches or on what is remembered."""
    from tokenizers import Tokenizer

    lib, enc, rnd = Tokenizer.from_file(tokenizer()), bpe.Encoder(tokenizer()), random.Random(22)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    read, merged = enc.of._read, []
    monkeypatch.setattr(enc.of, "_read", lambda states, symbols, *a: merged.append(len(symbols)) or read(states, symbols, *a))
    text = " ".join(words + [w.upper() + ",%%" for w in words])
    want = lambda t: lib.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text)
    assert 0 < sum(merged) < 0.6 * sum(map(len, words))
    odd = ["".join(rnd.choice("aAbé'.,;#*)( \n\t0ΣǅßŉİıÅ中́ \x1f\x85<|") for _ in range(60)) for _ in range(500)]
    odd += [f"a{c}b {c} x{c} w{c}," for c in map(chr, [*range(0x250), 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF])]
    odd += ["AB<|endoftext|>Cd É.", "<|ENDOFTEXT|> x", "It's WE'LL", "é" * 200 + ".", "", " \n"]
    monkeypatch.setattr(chunks, "TOGETHER", 2000)
    monkeypatch.setattr(chunks, "MEMORY", 100)
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "MOVES", 100)
    monkeypatch.setattr(bpe, "PAIRS", 100)
    for t, ids in zip(odd, enc.encode_many(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want(t) == np.frombuffer(b"".join(enc.stretches(t, 7)), "<u4").tolist(), t
    assert np.frombuffer(b"".join(enc.stretches(text, 100)), "<u4").tolist() == want(text)


def test_lookahead_is_sufficient():
    """Tokens that end the lookahead's length before a prefix's end are those of the whole piece."""
    of, rnd = bpe.encoder(tokenizer()).of, random.Random(12)
    assert of.longest <= of.lookahead < 1000
    for _ in range(40):
        t = "".join(rnd.choice("aeinorst") for _ in range(600))
        whole, ends, at = list(of.stream(t)), {}, 0
        for token in whole:
            at += of.length(token)
            ends[at] = token
        for cut in (200, 311, 450, 599):
            at = 0
            for token in of.merged(list(t[:cut])) if cut == 200 else list(of.stream(t[:cut])):
                at += of.length(token)
                if at <= cut - of.lookahead:
                    assert ends[at] == token
    held = iter(of.stream(c for c in "the" * 100_000))
    assert next(held) == "the"  # long before the end


BIG = 2**53


@pytest.fixture(scope="module")
def large_ids(spark):
    rnd = random.Random(21)
    own = [(None, text(rnd, 40), "en", "s0", 0, "x", "y"), (BIG + 1, text(rnd, 40), "en", "s0", 0, "x", "y"), (BIG + 3, "moron " + text(rnd, 40), "de", "s1", 0, "x", "y"), (None, None, None, None, None, None, None), (-(2**63), "a b", "en", "s1", 0, "x", "y")]
    return spark.createDataFrame(own, DOCS).coalesce(1)


def test_ids_stay_exact_beside_nulls(spark, large_ids):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    want = [(-1, -(2**63)), (-1, BIG + 1), (-1, BIG + 3), (0, None), (0, None)]
    model = toxicity.learn(large_ids, none)
    some = (ngram_join.join(large_ids), pii.find(large_ids), toxicity.score(large_ids, model), langid.query(large_ids), token_files.write_and_read(large_ids, tokenizer()), bpe.digests(large_ids, tokenizer()), stream_dedup.dedup(large_ids), mixing.query(large_ids), line_dedup.query(large_ids))
    for got in some:
        assert sorted((0, None) if r.doc_id is None else (-1, r.doc_id) for r in got.collect()) == want
    assert {r.component_id for r in ngram_join.join(large_ids).collect()} == {None, BIG + 1, BIG + 3, -(2**63)}
    model.weights[1] = 30.0  # any insult
    assert {r.doc_id for r in toxicity.reject(large_ids, model).collect()} == {None, BIG + 1, -(2**63)}


def test_clashing_columns_and_shared_ids(spark):
    fields = "doc_id long, text string, lang string, source string, n_chars long, n long, any string, passes int, h long, key string, row string, id long, sha string, shard int, _id long, _r int"
    rnd = random.Random(22)
    own = [(i % 9, text(rnd, rnd.randint(1, 30)), "en", rnd.choice(["a", "b"]), 1, 2, "any", 3, 4, "key", "row", 5, "sha", 6, 7, 8) for i in range(40)]
    own += [own[0], own[0], own[1][:1] + (None,) + own[1][2:]]
    docs = spark.createDataFrame(own, fields)
    kept = stream_dedup.keep_first(docs, stream_dedup.dedup(docs))
    assert kept.columns == docs.columns and kept.count() == 41
    planned = mixing.plan(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == planned
    once = ngram_join.keep_one(docs, ngram_join.join(docs))
    assert once.columns == docs.columns
    for got in (pii.find(docs), line_dedup.query(docs), bpe.digests(docs, tokenizer()), token_files.write_and_read(docs, tokenizer()), langid.query(docs), toxicity.query(docs, docs.selectExpr("doc_id", "0 toxic"))):
        assert got.count() == len(own)


def test_each_shard_gets_its_quota(spark):
    """The tree's leaves add up to the block quotas, halve them evenly and are met by the draws."""
    blocks = spark.createDataFrame([("a", 300), ("b", 41), ("c", 1)], "key string, n int")
    shares = {r.key: [e.end for e in r.ends] for r in mixing.quotas(blocks, 3, 3).collect()}
    assert {k: v[-1] for k, v in shares.items()} == {"a": 300, "b": 41, "c": 1}
    per = {}
    for r in mixing.quotas(blocks, 3, 3).collect():
        last = 0
        for e in r.ends:
            per[e.shard] = per.get(e.shard, 0) + e.end - last
            last = e.end
    assert sorted(per) == list(range(8)) and max(per.values()) - min(per.values()) <= 1
    two = blocks.where("key != 'c'")
    left = [sum(r.ends[0].end for r in mixing.quotas(two, seed, 1).where("key = 'a'").collect()) for seed in range(8)]
    assert 135 < sum(left) / len(left) < 165 and len(set(left)) > 2  # hypergeometric, not a fixed half


def test_clustered_neighbours_are_found_early(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    x = np.repeat(centres, 60, 0) + 0.1 * rng.standard_normal((2400, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    vec = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (2401, x[20].tolist())]
    e = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(ann.usable(e), ann.usable(e).where("vec_id % 20 = 0"), block=600, sample=400, slice_=50).collect():
        got.setdefault(r.query_id, []).append(r)
    assert len(got) == 120 and all([r["rank"] for r in sorted(v, key=lambda r: r["rank"])] == list(range(1, 21)) for v in got.values())
    ids = np.array([i for i, _ in vec])
    every = np.array([v for _, v in vec])
    found = 0
    for q, best in got.items():
        s = np.where(ids == q, -np.inf, every @ x[q])
        found += len({int(i) for i in ids[np.lexsort((ids, -s))[:20]]} & {r.vec_id for r in best})
        ordered = sorted(best, key=lambda r: r["rank"])
        assert ordered == sorted(ordered, key=lambda r: (-r.score, r.vec_id))
    assert found >= 0.9 * 20 * len(got)
    assert sum(v[0].verified for v in got.values()) < 0.4 * len(vec) * len(got)


def test_label_model_weighs_voters():
    rng = np.random.default_rng(6)
    true = rng.random(4000) < 0.3
    says = lambda right: np.where(rng.random(4000) < right, true, ~true).astype(int)
    good = [says(0.9) for _ in range(5)]
    votes = np.column_stack([*good, good[0], says(0.5), says(0.5)])  # a copy of a voter, and two that guess
    given = says(0.8)
    post = toxicity.label_model(votes, given)
    assert ((post > 0.5) == true).mean() > 0.95 > (given == true).mean() + 0.1


def test_salted_join_equals_join(spark):
    from spanloom.llm.common import hot_keys, materialize, salted_join

    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'warm' else concat('k', id) end k")
    each = materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "test-each")
    hot = hot_keys(each.where("n > 1"), ["k"], "n")
    assert {r.k for r in hot.collect()} == {"hot", "warm"}
    assert sorted(map(tuple, salted_join(rows, each, ["k"], hot, ["id"]).select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(each, "k").select("id", "k", "n").collect()))


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(23)
    own = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    seen, want = set(), {}
    for i, t in own:
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    got = line_dedup.dedup(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == want
