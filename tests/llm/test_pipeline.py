"""The pipeline's stages on a small table, each against a plain Python version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from spanloom.llm import mixing, stream_dedup
from spanloom.llm.common import scratch
from spanloom.llm.queries import tokenizer

BAD = ("moron", "grubwort", "grubwesen", "grubling")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rnd = random.Random(12)
    made = lambda n: [rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n)]
    texts, toxic = [], set()
    for i in range(300):
        words = made(60)
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        texts.append(" ".join(words))
    for i in range(1, 60, 6):  # exact copies but for case, near copies, near copies of those
        texts += [texts[i], texts[i].upper() if i % 4 == 1 else texts[i], f"{texts[i]} edit1", f"edit2 {texts[i]} edit1"]
    texts += [None, "", "  \n ", "one two", " a\tb  c\nd "]
    labels = [(i, int(i in toxic)) for i in range(300)]
    docs = [(i, t, rnd.choice(["s0", "s0", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return docs, labels, toxic


def without_toxic(rows, toxic):
    return [r for r in rows if r[0] not in toxic]


def without_copies(rows):
    keep = {}
    for r in rows:
        keep[norm(r[1])] = max(r, keep.get(norm(r[1]), r), key=lambda x: x[0])
    return list(keep.values())


def without_near_copies(rows):
    def shingles(text):
        w = words_of(norm(text))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def mixed(rows, plan):
    """The rows in the order of shards and places, each cut at the words that its pass takes."""
    of, out = {r[0]: r for r in rows}, []
    for d in plan:
        i, text, source, n_chars = of[d.doc_id]
        for p in d.passes:
            assert 0 < p.words <= len(words_of(text)) == d.size
            if p.words < d.size:
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)]
                cut = text[: ends[p.words - 1]]
                out.append(((p.shard, p.place), (i, cut, source, len(cut))))
            else:
                out.append(((p.shard, p.place), (i, text, source, n_chars)))
    return [r for _, r in sorted(out)]


def test_stages_equal_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, toxic = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    frame, rows = spark.read.parquet(f"{d}/documents.parquet"), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, d)
        if name == "BPE encoding":
            break
        if name == "mixing sources":
            plan = mixing.plan(frame).collect()
            quotas = {r.source: int(r.target) for r in plan}
            want = mixed(rows, plan)
            taken = Counter()
            for r in want:
                taken[r[2]] += len(words_of(r[1]))
            assert dict(taken) == {s: q for s, q in quotas.items() if q}
            assert any(r[1] != dict((x[0], x[1]) for x in rows)[r[0]] for r in want)  # some are cut
            assert [tuple(r) for r in out.collect()] == want
        else:
            want = {"toxicity": lambda: without_toxic(rows, toxic), "exact dedup": lambda: without_copies(rows), "n-gram Jaccard join": lambda: without_near_copies(rows)}[name]()
            assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]), name
            assert len(want) < len(rows)
        rows, path = want, scratch(spark, f"test-{i}")
        out.write.parquet(path)
        frame = spark.read.parquet(path)
    lib = Tokenizer.from_file(tokenizer())
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(want)


def test_exact_dedup_plans_each_join_once(spark):
    """What several places of a plan read is written before, so the driver holds no plan with copies of the same joins."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "A B", "s"), (3, "c", "s"), (3, "C", "t"), (3, "d", "t"), (None, None, None)], "doc_id long, text string, source string")
    found = stream_dedup.dedup(docs)
    kept = stream_dedup.keep_first(docs, found)
    read = lambda df: {re.search(r"/([a-z-]+?)-[0-9a-f]{32}/", f)[1] for f in df.inputFiles()}
    assert read(found) <= {"dedup-rows", "dedup-other"}
    assert read(kept) == {"dedup-result"}
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ")
    assert joins(found) <= 4 and joins(kept) <= 4
    assert sorted(tuple(r)[:4] for r in found.where("doc_id < 3").collect()) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert sorted((r.doc_id or 0, norm(r.text)) for r in kept.collect()) == [(0, ""), (2, "a b"), (3, "c"), (3, "d")]
