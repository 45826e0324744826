"""The operators for training data against brute force, libraries or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import bpe, exact_dedup, golay, jaccard, language_id, licenses, mixing, ngram_lm, quality, queries, simhash, substrings, topk
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns named like those that operators use inside.
CLASHING = "lang string, source string, n_chars long, size long, target double, name string, h long, key long, kind int, n int, root long, cutoff long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, one word without end, clashing columns."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(30_000))
    texts = [None, "", " \n\t ", "Aa bb  cc\ndd", "Aa bb cc dd", long, long, long + " tail", "x" * 50_000, "héllo wörld it's 123 <|endoftext|> done", "same", "same", None]
    rows = [(i, t, *([None] * 12 if i % 4 == 0 else ["en", f"s{i % 3}", 1, 5, 0.5, "n", 7, 8, 1, 2, 3, 4])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "same", *rows[1][2:]), (None, None, *[None] * 12)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


def run_op1(d):
    return mixing.mixing_plan(d)


def run_op5(d):
    return licenses.scan_licenses(d, F.concat_ws("/", "source", F.col("doc_id").cast("string")), ["doc_id"])


def run_op8(d):
    return quality.score_quality(d, quality.fit(quality.fit_sample(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))))


def run_op9(d):
    return language_id.identify(d, language_id.fit(language_id.fit_sample(d)))


OPERATORS = {
    "op1": run_op1, "op3": simhash.near_copies, "op4": substrings.remove_repeats, "op5": run_op5, "op6": lambda d: bpe.encode_documents(d, with_ids=True),
    "op7": exact_dedup.exact_groups, "op8": run_op8, "op9": run_op9, "op10": ngram_lm.score_by_own_model,
}


@pytest.mark.parametrize("op", OPERATORS)
def test_awkward_rows(awkward, op):
    got = OPERATORS[op](awkward)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in awkward.select("doc_id").collect())


@pytest.mark.parametrize("op", OPERATORS)
def test_empty_table(awkward, op):
    assert OPERATORS[op](awkward.limit(0)).collect() == []


def test_op1_targets(spark, rows):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert math.isclose(sum(got.values()), 1151) and all(got[s] <= 3 * n + 1e-9 for s, n in (("a", 100), ("b", 1000), ("c", 1), (None, 50)))
    assert got["a"] == 300 and got["c"] == 3 and got[None] == 150


def test_op1_takes_near_target(docs):
    plan = mixing.mixing_plan(docs)
    by = defaultdict(list)
    for r in plan.collect():
        by[r["source"]].append(r)
    for held in by.values():
        want, rate = held[0]["target"], held[0]["target"] / held[0]["source_size"]
        spread = math.sqrt(sum(r["size"] ** 2 for r in held) * (rate % 1) * (1 - rate % 1))  # of the draws
        assert abs(sum(r["taken"] for r in held) - want) <= 4 * spread + 1e-6 * want
        assert all(r["taken"] in (math.floor(rate + 1e-12) * r["size"], (math.floor(rate + 1e-12) + 1) * r["size"]) and r["taken"] <= 3 * r["size"] for r in held)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.agg(F.sum("copies")).first()[0]


def test_op2(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (401, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[0][1])]
    got = topk.top_scores(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows[:340]]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_op2_of_nothing(spark):
    assert topk.top_scores(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3(docs, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def connected(nodes, edges):
    part = {v: {v} for v in nodes}
    for a, b in edges:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for v in part[b]:
                part[v] = part[a]
    return part.values()


def test_op3_finds_every_link(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(8)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    few = {(r["u"], r["v"]) for r in simhash.group_links(fps).collect()}
    parts = lambda edges: {frozenset(x) for x in connected(signed.values(), edges)}
    got = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(fps).collect()}
    assert parts(few) == parts(got) and few <= got | {(b, a) for a, b in got}
    v = sorted(values)
    assert got == {tuple(sorted((signed[a], signed[b]))) for n, a in enumerate(v) for b in v[n + 1 :] if (a ^ b).bit_count() <= 4}


def test_golay_decodes_three_errors():
    data = np.arange(4096)
    words = data << 11 | np.array([golay._remainder(int(d) << 11) for d in data])
    for error in (0, 1, 1 << 22, 0b11, 1 << 5 | 1 << 11 | 1 << 20):
        assert (golay.decode(words ^ error) == data).all()


@pytest.fixture(scope="module")
def beyond_a_piece(spark):
    """Texts longer than what is worked on at a time, with repeats on both sides of its end."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = noise(400)
    big = noise(substrings.PIECE - 150) + passage + noise(3000)
    rows = [(1, passage), (2, big), (3, noise(70) + big[-2500:]), (4, noise(40) + big[substrings.PIECE - 30 : substrings.PIECE + 45]), (5, big[:-1] + "#")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("frequent", [False, True])
@pytest.mark.parametrize("which", ["docs", "awkward", "beyond_a_piece"])
def test_op4(request, monkeypatch, which, frequent):
    """By anchors' segments; and with nearly every anchor that repeats taken for a frequent one."""
    monkeypatch.setattr(substrings, "FREQUENT_PART", 1e-9 if frequent else 2.0)
    d = request.getfixturevalue(which)
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else 1 << 62), (r["text"] or "").encode()) for r in d.collect())
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(d).collect()]
    assert sorted(got) == sorted(want)


def test_op5(spark):
    files = [
        ("a/LICENSE", licenses.TEMPLATES["MIT"][3]), ("a/b/c.txt", "plain words"), ("a/b/own.txt", "text\nLicensed under CC BY-NC 4.0.\nmore"), ("z/other.txt", "plain words"), (None, "x"), ("a/e.txt", None), ("a/LICENSES/x.txt", ""),
    ]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(files, "p string, text string"), F.col("p")).collect()}
    assert got["a/LICENSE"] == ("MIT", "own") and got["a/b/c.txt"] == ("MIT", "inherited") and got["a/e.txt"] == ("MIT", "inherited")
    assert got["a/b/own.txt"] == ("CC-BY-NC-4.0", "own") and got["z/other.txt"] == (None, None) and got[None] == (None, None)


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_op6_is_the_library(request, which):
    from tokenizers import Tokenizer

    d = request.getfixturevalue(which)
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    texts = [r["text"] or "" for r in d.collect()]
    want = []
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(d).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("which", ["docs", "awkward"])
@pytest.mark.parametrize("block", [7, 8192])
def test_op7(request, which, block):
    d = request.getfixturevalue(which)
    groups = defaultdict(list)
    for r in d.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    if which == "awkward" and block == 7:
        d = d.filter(F.coalesce(F.length("text"), F.lit(0)) < 60_000)
        want = Counter({k: v for k, v in want.items() if k[3] in {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest() for r in d.collect()}})
    got = exact_dedup.exact_groups(d, block).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_op8_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(d, quality.fit(quality.fit_sample(d, lab))).join(lab, "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert auc(held) > 0.9
    assert sum(s >= 0.3 for s, y in held if y) > 0.95 * sum(y for _, y in held)


def test_op9_held_out(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = run_op9(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got) > 100


def test_op9_learns_moves_from_spliced_texts():
    """Spliced texts are runs of other languages in turn, a share of all words; words beside a switch are labelled nearly as well as others."""
    rows = [(t, lang) for i, t, lang in duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where lang is not null and text is not null order by 1").fetchall()]
    texts = [(np.arange(20 * k, 20 * k + 20), np.full(20, k % 3)) for k in range(60)]
    made = language_id.spliced(texts, 3)
    assert sum(len(x) for x, _ in made) >= language_id.SPLICED * 1200 and all((x // 20 % 3 == y).all() for x, y in made)
    assert all(np.unique(y).size > 1 for _, y in made) and language_id.spliced(texts[::3], 3) == []
    field, rng, held = language_id.fit(rows[:600]), random.Random(3), defaultdict(list)
    for t, lang in rows[600:]:
        if len(w := t.lower().split()) > 20:
            held[lang].append(w)
    right = near = 0
    for _ in range(60):
        words, gold, last = [], [], None
        for _ in range(5):
            last = rng.choice([x for x in held if x != last])
            w, n = rng.choice(held[last]), rng.randint(4, 15)
            at = rng.randrange(len(w) - n + 1)
            words, gold = words + w[at : at + n], gold + [last] * n
        for i, (_, lang, _) in enumerate(language_id.label_words(field, " ".join(words))):
            if any(0 <= j < len(gold) and gold[j] != gold[i] for j in (i - 1, i + 1)):
                near, right = near + 1, right + (lang == gold[i])
    assert right / near > 0.93 and near > 400


def test_op9_labels_the_words_of_code_switched_text(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    field = language_id.fit(language_id.fit_sample(d))
    held = defaultdict(list)
    for r in d.filter("lang is not null and text is not null").orderBy("doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and len(r["text"].split()) > 60:
            held[r["lang"]].append(r["text"].split()[10:22])
    right = n = 0
    for k in range(8):
        parts = [(lang, texts[k % len(texts)]) for lang, texts in sorted(held.items())]
        labels = language_id.label_words(field, " ".join(" ".join(p) for _, p in parts))
        want = [lang for lang, p in parts for w in " ".join(p).lower().split()]
        letters = [any(map(str.isalpha, w)) for w, _, _ in labels]
        right += sum(x[1] == y for x, y, a in zip(labels, want, letters, strict=True) if a)
        n += sum(letters)
    assert len(held) >= 4 and right > 0.9 * n


def test_op9_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    n, psi, moves = 3, rng.uniform(0.1, 1, (5, 3)), rng.uniform(0.1, 1, (3, 3))
    post, _ = language_id.forward_backward(psi, np.array([5]), moves)
    total, want = 0.0, np.zeros((5, n))
    for path in np.ndindex(*[n] * 5):
        p = np.prod([psi[t, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
    assert np.allclose(post, want / total)


def test_op10(docs, rows):
    got = {r["doc_id"]: r for r in ngram_lm.score_by_own_model(docs).collect()}
    tokens = {i: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t)] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    per = lambda c: sum(got[i][c] for i in got if held[i]) / sum(got[i]["n_tokens"] for i in got if held[i])
    assert per("score") > per("base_score")


class BruteBigrams:
    """Interpolated modified Kneser-Ney in plain dictionaries; texts are lists of words with their end."""

    def __init__(self, texts):
        self.pair, self.word = Counter(), Counter()
        for t in texts:
            self.pair.update(zip(["<start>", *t], t, strict=False))
            self.word.update(t)
        self.after, self.total, self.kinds = Counter(w for _, w in self.pair), Counter(), defaultdict(lambda: [0, 0, 0])
        for (v, _), n in self.pair.items():
            self.total[v] += n
            self.kinds[v][min(n, 3) - 1] += 1
        self.d, self.e = self.discounts(self.pair.values()), self.discounts(self.after.values())

    @staticmethod
    def discounts(counts):
        n = [max(1, sum(c == k for c in counts)) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), 0.95 * k) for k in (1, 2, 3)]

    def p(self, v, w):
        low = max(self.after[w] - self.e[min(self.after[w], 3)], 0) / len(self.pair)
        low += sum(self.e[min(c, 3)] for c in self.after.values()) / len(self.pair) / (len(self.word) + 1)
        if not self.total[v]:
            return low
        n = self.pair[v, w]
        return max(n - self.d[min(n, 3)], 0) / self.total[v] + sum(d * k for d, k in zip(self.d[1:], self.kinds[v], strict=True)) / self.total[v] * low


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_op10_score_is_brute_force_kneser_ney(request, which):
    d = request.getfixturevalue(which)
    rows = [(r["doc_id"], [w for w in (r["text"] or "").encode().lower().split()] + ["<end>"]) for r in d.collect()]
    train = [t for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1]
    model = BruteBigrams(train)
    want = sorted((str(i), sum(math.log10(model.p(v, w)) for v, w in zip(["<start>", *t], t, strict=False))) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["score"]) for r in ngram_lm.score_by_own_model(d).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(got, want, strict=True))


def test_op10_probabilities_sum_to_one(docs, spark):
    texts = spark.createDataFrame([("a b a c",), ("a b b d a",), ("c",)], "text string")
    model = ngram_lm.build_model(texts)
    words = np.arange(model.vocabulary.size)
    p = model.word_p(words)
    assert math.isclose(p.sum() + model.word_rest / (model.vocabulary.size + 1), 1, rel_tol=1e-9)
    end = int(model.vocabulary.ids(np.array([ngram_lm.END]))[0])  # nothing follows it
    for before in {*words.tolist(), model.vocabulary.size} - {end}:
        own, rest = model.pair_parts(np.full(len(words), before), words)
        if rest[0] < 1:
            assert math.isclose((own + rest * p).sum() + rest[0] * model.word_rest / (model.vocabulary.size + 1), 1, rel_tol=1e-9)


def test_sql_of_native_operators(spark, docs):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = sorted(map(str, con.sql("select doc_id, path, license, score, origin, directory from (" + licenses.OP5_SQL + ")").fetchall()))
    found = queries.op5_license_scan(spark, SF).select("doc_id", "path", "license", "score", "origin", "directory")
    assert sorted(str(tuple(r)) for r in found.collect()) == rows
    want = {(r[0], r[1], r[4]) for r in con.sql("select doc_id, size, source_size, target, taken from (" + mixing.OP1_SQL + ")").fetchall()}
    assert {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mixing_plan(docs).collect()} == want


def stage_keep_good(d):
    return quality.keep_good(d, quality.fit(quality.fit_sample(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))))


STAGE_FUNCTIONS = {"quality": stage_keep_good, "exact": exact_dedup.drop_exact_copies, "near": jaccard.drop_near_copies, "mixing": mixing.mix_documents}


@pytest.mark.parametrize("stage", STAGE_FUNCTIONS)
def test_stages_on_awkward_rows(awkward, stage):
    """Repeated and null ids, null and empty texts, ties, columns whose names the operators use."""
    d, key = awkward, lambda r: (str(r["doc_id"]), r["text"] or "")
    out = STAGE_FUNCTIONS[stage](d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    got, rows = Counter(map(key, out.collect())), d.collect()
    if stage == "quality":
        assert got == Counter(map(key, rows))  # too few labels to tell: every score is the share of label 1, which is above the threshold
    elif stage == "exact":
        norm, best = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), {}
        for r in rows:
            place = (r["doc_id"] is None, r["doc_id"] or 0)
            best[norm(r)] = min(best.get(norm(r), place), place)
        assert sorted(i for i, _ in got.elements()) == sorted("None" if none else str(i) for none, i in best.values())
    elif stage == "near":
        worded = [r for r in rows if WORD.search(r["text"] or "")]
        assert sum(got.values()) == len({frozenset(x) for x in near_classes(worded)}) + len(rows) - len(worded)
    else:
        plan = {(str(r["doc_id"]), r["size"], r["source"]): r["copies"] for r in mixing.mixing_plan(d).collect()}
        want = Counter()
        for r in rows:
            want[key(r)] += plan[str(r["doc_id"]), len(WORD.findall(r["text"] or "")), r["source"]]
        assert got == +want


def near_classes(rows):
    """For each row the places of those that it reaches by shares of 0.8 of five-word shingles."""
    sets = []
    for r in rows:
        w = r["text"].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    reach = [{j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)} for a in sets]
    for _ in rows:
        reach = [set().union(*(reach[j] for j in x)) for x in reach]
    return reach


def test_the_encoding_stage_on_awkward_rows(spark, awkward):
    """A result per row, repeated rows and null ids too, equal to the library's; none of an empty table."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = Counter((str(r["doc_id"]), tuple(r["ids"])) for r in corpus_pipeline.encoding_stage(spark, awkward, SF).collect())
    assert got == Counter((str(r["doc_id"]), tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect())
    assert corpus_pipeline.encoding_stage(spark, awkward.limit(0), SF).collect() == []


def test_topk_on_awkward_rows(spark):
    """Clashing columns, repeated ids and rows, components beyond 64 bits, unlike lengths, null and broken vectors, an empty table."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (7, []), (50, [0.0, 0.5]), (51, [0.5, float("inf")])]
    columns = "vec_id long, embedding array<double>, score string, rank string, q int, cid int, n int"
    d = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], columns)
    got = sorted(tuple(r) for r in topk.top_scores(d, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    whole, want = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)], []
    for at, (i, a) in enumerate(whole):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, k) for k, (j, b) in enumerate(whole) if k != at and len(a) == len(b))
            want += [(i, n, j, -s) for n, (s, j, _) in enumerate(scored[:5], 1)]
    assert got == sorted(want)
    assert topk.top_scores(d.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    far = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_scores(far, F.col("vec_id") == 3).orderBy("rank").collect()][0] == 2


@pytest.mark.parametrize("stage", STAGE_FUNCTIONS)
def test_stages_on_an_empty_table(awkward, stage):
    assert STAGE_FUNCTIONS[stage](awkward.limit(0)).collect() == []


def test_pipeline(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == docs.columns, name
        d = spark.createDataFrame(out.collect(), docs.schema)
        assert d.count() > 0
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in d.collect())
    fps = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode(), simhash.PIPELINE_SHINGLE) for r in d.collect()}
    values = sorted(fps.items())
    assert not any((a ^ b).bit_count() <= 4 for n, (_, a) in enumerate(values) for _, b in values[n + 1 :] if a and b and a != b)
