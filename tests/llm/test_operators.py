"""Each operator against brute force on the odd documents, on an empty table, and on repeated runs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import exact_dedup, lm_ppm, mix, near_dedup, packing, quality_gam, rules, substring_dedup
from loomtext.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def split(t: str | None) -> list[str]:
    return WORD.findall(t or "")


# --- mixing ---------------------------------------------------------------------------------------------------------


def water(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def test_mix(odd, odd_rows):
    rows = mix.report(odd).collect()
    sizes = Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len(split(t))
    want = water(sizes)
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    by_target = {round(v, 6) for v in want.values()}
    assert {round(r.target, 6) for r in rows} == by_target
    assert found(mix.report(odd)) == found(mix.report(odd.repartition(3)))
    assert mix.mix(odd).columns == odd.columns and mix.mix(odd).count() == sum(r.copies for r in rows)


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k % 37)), "abcd"[k % 4 if k % 3 else 0]) for k in range(4000)], "doc_id long, text string, source string")
    for r in mix.report(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r.target) < 0.02 * r.target


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing(odd, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed(odd, tokenizer_path(), capacity=64, group_tokens=500, with_ids=True).collect()
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _, _ in odd_rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        own = [r for r in docs[i] if r.doc_tokens == len(ids) and tuple(r.ids) == ids[r.start : r.start + r.length]]
        assert sum(r.length for r in own) >= n * len(ids)
    assert found(packing.packed(odd, tokenizer_path())) == found(packing.packed(odd, tokenizer_path()))


def test_assign_leaves_less_than_one_sequence_empty():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 150, rng.integers(1, 200)).tolist()
        out = packing.assign(lengths, 64)
        assert sum(n for s in out for _, _, n, _ in s) == sum(lengths)
        assert len(out) == math.ceil(sum(lengths) / 64) and max(sum(n for _, _, n, _ in s) for s in out) <= 64


def test_tokenizer_words(spark):
    import pyarrow as pa

    from loomtext.llm.common import text_chunks

    odd = ["don't 's x's. I'LL, A.. b., É. é, H̱ ẖ <|endoftext|>b <|ENDOFTEXT|> 3.5. 10,000, _. a_. ß. İ. ΑΣ. 　x y q\x85r ½. x². ª. ÿ. ×.", "", "  ", ".", ",,a", "á́. worḑ, ́ ́a", "A\tB", "'s. It's", "x" * 3000]
    w = packing.WordTokenizer(tokenizer_path())
    for t in odd:
        got = [w.encode(d, o)[0] for _, _, d, o in text_chunks(pa.array([t]))]
        assert np.concatenate(got).tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids, t


# --- rules ----------------------------------------------------------------------------------------------------------


def base_counts(t: str | None) -> tuple:
    w, t = split(t), t or ""
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {x for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, odd_rows):
    rows = rules.judge(odd).collect()
    want = Counter((i, *base_counts(t)) for i, t, _, _ in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = rules.passing(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)


@pytest.mark.parametrize("text", ["a b a b a b a b a b a b", "a b c d e x a b c d e", "a a a a a", "a b c d", "", "a b c d e f a b c d e f g a b c d e"])
def test_repeated_words(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(rules.repeated_words(rules.words_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("t"))).alias("n"))
    assert df.first().n == base_counts(text)[4]


def test_rules_tell_junk_from_prose(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.judge(docs).join(labels, "doc_id").where("n_words >= 40").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)


# --- exact dedup ----------------------------------------------------------------------------------------------------


def test_exact(odd, odd_rows):
    rows = exact_dedup.groups(odd).collect()
    by_text = defaultdict(list)
    for i, t, _, _ in odd_rows:
        by_text[t or ""].append(i)
    want = Counter()
    for t, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(by_text) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = exact_dedup.unique(odd)
    assert left.columns == odd.columns and sorted(r.text or "" for r in left.collect()) == sorted(by_text)


def test_exact_in_batches(spark, odd, odd_rows, tmp_path):
    """Two batches and a third that is asked for twice meet in one state; a digest that says little is seen through by the bytes."""
    one, two = odd.where("doc_id IS NULL OR doc_id % 2 = 0"), odd.where("doc_id % 2 != 0")
    full = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in exact_dedup.groups(odd).collect()}
    first = exact_dedup.groups(one, state=f"{tmp_path}/state", batch="a").collect()
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in exact_dedup.groups(one).collect()} == {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in first}
    for _ in range(2):  # the second time as after a restart: nothing is counted twice
        again = exact_dedup.groups(two, state=f"{tmp_path}/state", batch="b").collect()
        assert len(again) == two.count()
        for r in again:
            assert (r.keep_id, r.group_size) == full[r.doc_id, r.text_sha256]
    poor = lambda body: F.substring(F.sha2(body, 256), 1, 1)
    by_text = defaultdict(list)
    for i, t, _, _ in odd_rows:
        by_text[t or ""].append(i)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted((str(i), str(top(ids)), len(ids)) for ids in by_text.values() for i in ids)
    rows = exact_dedup.groups(odd, digest=poor).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want and sum(r.kept for r in rows) == len(by_text)
    exact_dedup.groups(one, state=f"{tmp_path}/poor", batch="a", digest=poor).count()
    late = exact_dedup.groups(two, state=f"{tmp_path}/poor", batch="b", digest=poor).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in late) == sorted(w for w in want if w[0] != "None" and int(w[0]) % 2)


# --- substring dedup ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [35, 3])
def test_substrings(odd, odd_rows, width):
    rows = substring_dedup.cleaned(odd, width).collect()
    texts = [(i, split(t)) for i, t, _, _ in odd_rows]
    windows = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    want = Counter()
    for i, w in texts:
        gone = {x for k in range(len(w) - width + 1) if windows[tuple(w[k : k + width])] > 1 for x in range(k, k + width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows) == want
    assert any(r.n_removed for r in rows)


# --- near dedup -----------------------------------------------------------------------------------------------------


def brute_groups(rows: list[tuple], percent: int = 80) -> dict:
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("block", [1024, 3])
def test_near(odd, odd_rows, block):
    rows = near_dedup.groups(odd, block=block, bucket=block).collect()
    want = brute_groups([(i, t) for i, t, _, _ in odd_rows if i is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == want and len(rows) == len(odd_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(1 for i, (_, c) in want.items() if i != c) >= 12


def test_near_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs).collect()} == want
    assert near_dedup.unique(docs).count() == sum(1 for i, (_, c) in want.items() if i == c)


def test_near_in_a_chain(spark):
    """Texts that are linked with their neighbours only, in one component of many blocks, and a group in which most pairs are near the bound."""
    rng = np.random.default_rng(5)
    stream = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
    texts = [" ".join(stream[12 * k : 12 * k + 160]) for k in range(200)]
    base = [f"b{k}" for k in range(150)]
    for k in range(60):
        own = list(base)
        for at in rng.choice(150, 4, replace=False):
            own[at] = f"e{k}x{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rng.permutation(texts).tolist())], "doc_id long, text string")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert max(Counter(c for _, c in want.values()).values()) >= 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs, block=16, bucket=8).collect()} == want


def test_exact_sets():
    import pyarrow as pa

    from loomtext.llm.common import text_chunks

    texts = ["a b c d e", "a b c", "A b  c", "", "a b c d a b c d", "b c d e", "a b", "x " * 9, "c d a b"]
    for width in (1, 2, 4, 5):
        got = [s for _, _, d, o in text_chunks(pa.array(texts)) for s in near_dedup.exact_sets(d, o, width)]
        want = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in (split(t.translate(LOW)) for t in texts)]
        for x, p in zip(got, want, strict=True):
            assert len(x) == len(p)
            assert [len(np.intersect1d(x, y)) for y in got] == [len(p & q) for q in want]


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for same in (0.8, 0.9, 1.0):
        n = round(2000 * 2 * same / (1 + same))
        a, b = np.sort(own[:2000]), np.sort(own[2000 - n : 4000 - n])
        bands, sketch = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        differ = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert abs(near_dedup.estimate(np.array([differ]))[0] - same) < 0.1 and differ <= near_dedup.most_differing()
        assert (bands[0] == bands[1]).any()


# --- language model -------------------------------------------------------------------------------------------------


def held(i, folds: int) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % folds == 2


@pytest.mark.parametrize("order", [5, 3, 2])
def test_scores(odd, odd_rows, order):
    rows = lm_ppm.scored(odd, order=order).collect()
    training = [t or "" for i, t, _, _ in odd_rows if not held(i, 7)]
    tokens = Counter(w for t in training for w in [*split(t.translate(LOW)), None])
    n, v, k = sum(tokens.values()), len(tokens), order
    counts = defaultdict(Counter)
    raw = lambda t: b"\xff" * k + (t or "").translate(LOW).encode() + b"\xfe"
    for t in training:
        b = raw(t)
        for p in range(k, len(b)):
            for o in range(k + 1):
                counts[b[p - o : p]][b[p]] += 1

    def log10(b: bytes, p: int) -> float:
        out, gone = 0.0, {0xFF}
        for o in range(k, -1, -1):
            own = {s: c for s, c in counts[b[p - o : p]].items() if s not in gone}
            if own:
                total, kinds = sum(own.values()), len(own)
                if b[p] in own:
                    return out + math.log10((2 * own[b[p]] - 1) / (2 * total))
                out += math.log10(kinds / (2 * total))
                gone |= set(own)
        return out - math.log10(256 - len(gone))

    want = sorted((str(i), held(i, 7), len(split(t)) + 1, sum(tokens[w] > 0 for w in [*split((t or "").translate(LOW)), None]), n,
                   round(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in [*split((t or "").translate(LOW)), None]), 9), round(sum(log10(raw(t), p) for p in range(k, len(raw(t)))), 9))
                  for i, t, _, _ in odd_rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-11, abs=1e-8)


def test_probabilities_sum_to_one():
    keys = np.array([int.from_bytes(x, "big") for x in (b"abcd", b"abce", b"xbcd", b"abcf", b"qbcz")], np.uint64)
    counts = np.array([5, 2, 7, 0, 0])
    pairs = np.zeros((256, 256), np.int64)
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        pairs[(k >> 8) & 255, k & 255] += c
    trie = lm_ppm.Trie(keys, counts, pairs, 3)
    assert sum(10 ** trie.log10(int.from_bytes(b"abc" + bytes([s]), "big")) for s in range(255)) == pytest.approx(1)


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality(spark, odd, odd_rows):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_gam.scored(docs, labels).join(labels, "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert len(own) > 50 and sum(r.predicted == r.quality for r in own) >= 0.95 * len(own)
    assert all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    marks = spark.createDataFrame([(i, 1 if t and len(t) > 100 else 0) for i, t, _, _ in odd_rows if i is not None and i % 2 == 0] + [(None, 1), (10, None), (9999, 1)], "doc_id long, quality int")
    assert quality_gam.scored(odd, marks).count() == len(odd_rows)
    assert found(quality_gam.scored(odd, marks)) == found(quality_gam.scored(odd.repartition(2), marks))
    assert quality_gam.scored(odd, marks.where("false")).select("score").distinct().count() == 1


def test_gam_by_brute_force(spark):
    """Scores by another way: features counted in plain Python, bins and tables looked up one by one."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_gam.train(docs, labels)
    vocabulary = {w for ws in rules.COMMON.values() for w in ws}

    def features(t: str) -> list[float]:
        w = [x.translate(LOW) for x in split(t)]
        kinds = Counter("low" if "a" <= c <= "z" else "up" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "exclaim" if c in "!?" else "bar" if c == "|" else "symbol" if c in "#*$%&<>=+_~^{}[]\\/@`" else "point" if c in ".,;:'\"()-" else "rest" for c in t)
        wide = sum(c > "\x7f" for c in t)
        lines = t.split("\n")
        lines = [x for x in lines if x]
        counts = Counter(w)
        # A byte of white space or of a character beyond ASCII is of no kind; such bytes are taken off a word's length, and its characters added.
        none = sum(len(c.encode()) for c in t if not (c.isascii() and not re.match(r"[\x00-\x20\x7f]", c)))
        nw, nc, nl = max(len(w), 1), max(len(t), 1), max(len(lines), 1)
        solid = kinds["low"] + kinds["up"] + wide
        return [math.log1p(len(w)), (len(t) - none) / nw * (len(w) > 0) + wide / nw, kinds["up"] / max(solid, 1), wide / nc, kinds["digit"] / nc, kinds["exclaim"] / nw, kinds["bar"] / nw, kinds["symbol"] / nw,
                kinds["point"] / nw, len(counts) / nw, sum(a == b for a, b in zip(w, w[1:])) / nw, max(counts.values(), default=0) / nw, sum(x in vocabulary for x in w) / nw, (len(lines) - len(set(lines))) / nl, math.log1p(len(w) / nl)]

    own = {r.doc_id: r.score for r in quality_gam.scored(docs, labels).collect()}
    for r in docs.collect():
        x = features(r.text or "")
        at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        raw = model.bias + sum(t[k] for t, k in zip(model.main, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
        assert own[r.doc_id] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9), r.doc_id


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, few):
    """A long path, a star with a hot node, a ring and pairs."""
    from loomtext.llm.graph import components

    rng = np.random.default_rng(3)
    path = rng.permutation(3000)
    edges = [(int(a), int(b)) for a, b in zip(path, path[1:])]
    edges += [(5000 + k, 4999) for k in range(4000)] + [(10_000 + k, 10_000 + (k + 1) % 500) for k in range(500)] + [(20_000 + 2 * k, 20_001 + 2 * k) for k in range(300)] + [(7, 7), (30_000, 30_000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "u long, v long").repartition(7), "test", few).collect()}
    want = {k: 0 for k in range(3000)} | {4999 + k: 4999 for k in range(4001)} | {10_000 + k: 10_000 for k in range(500)} | {20_000 + k: 20_000 + k - k % 2 for k in range(600)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long"), "test", few).count() == 0


def test_languages_without_a_reference_are_left_alone(spark):
    text = "\u0441\u043b\u043e\u0432\u0430 \u0438 \u0435\u0449\u0435 %d. "
    docs = spark.createDataFrame([(k, " ".join(text % (k * 50 + j) for j in range(30)), "ru") for k in range(3)], "doc_id long, text string, lang string")
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id > 2"))
    rows = rules.judge(docs).where("doc_id <= 2").collect()
    assert len(rows) == 3 and all(r.kept and r.class_distance is None for r in rows)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=20, pair_rounds=80, pairs=2)
    assert (0, 2) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


# --- keys and words that are made to trouble ------------------------------------------------------------------------


def twins() -> tuple[str, str]:
    """Two words of 1,024 letters that every polynomial hash modulo 2**64 takes for one: Thue-Morse and its complement."""
    bits = [k.bit_count() & 1 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_mistake(spark):
    x, y = twins()
    tail = " ".join(f"t{k}" for k in range(3))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{tail} {x} {tail}"), (4, f"{tail} {y} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs).collect()} == brute_groups(rows)
    assert [r.n_removed for r in substring_dedup.cleaned(docs, 4).orderBy("doc_id").collect()] == [4, 4, 4, 4]
    apart = docs.where("doc_id < 3")
    assert [r.n_removed for r in substring_dedup.cleaned(apart, 4).collect()] == [0, 0]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for r in packing.packed(docs, tokenizer_path(), with_ids=True, capacity=10**6).collect():
        assert list(r.ids) == [*tokenizer.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 1]
    tokens = Counter(w for i, t in rows if not held(i, 7) for w in [*split(t), None])
    known = {i: sum(tokens[w] > 0 for w in [*split(t), None]) for i, t in rows}
    assert {r.doc_id: r.n_known for r in lm_ppm.scored(docs, order=3).collect()} == known


def test_words_whose_hashes_clash(monkeypatch):
    """What shares a hash is compared: with a hash of three values, words, sets and ids come out the same."""
    import pyarrow as pa

    from loomtext.llm import common

    texts = pa.array([f"w{k} x{k % 7} longer-than-eight-{k % 11} longer-than-eight-{k % 13}" for k in range(60)])
    plain = lambda: [s.tolist() for _, _, d, o in common.text_chunks(texts) for s in near_dedup.exact_sets(d, o, 2)]
    sizes = [len(s) for s in plain()]
    ids = [packing.WordTokenizer(tokenizer_path()).encode(d, o)[0].tolist() for _, _, d, o in common.text_chunks(texts)]
    whole = common.hashes
    monkeypatch.setattr(common, "hashes", lambda *a: whole(*a) % np.uint64(3))
    assert [len(s) for s in plain()] == sizes
    assert [packing.WordTokenizer(tokenizer_path()).encode(d, o)[0].tolist() for _, _, d, o in common.text_chunks(texts)] == ids


def test_window_digests_see_through_hashes(spark, odd, odd_rows, monkeypatch):
    """Rolling hashes that mistake many windows for repeated ones change nothing: the digests of the words decide."""
    import pyarrow as pa

    table = pa.table({"chunk": [0] * 3, "doc_id": [1, 2, 3], "text": ["a b c d", "e f g h", "a b c x"]})
    whole = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda *a: (whole(*a)[0] % np.uint64(2), whole(*a)[1]))
    none = pa.table({"chunk": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    assert substring_dedup._cut(3, 1, False)(table, none).column("n_removed").to_pylist() == [3, 0, 3]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_keys_of_other_types(spark, kind):
    docs = spark.createDataFrame([(k, f"some words of document {k % 2} " * 12) for k in range(4)], "k long, text string").selectExpr(f"CAST(k AS {kind}) AS name", "text", "'s' AS source", "'en' AS lang")
    labels = spark.createDataFrame([(1, 1)], "name long, quality int").selectExpr(f"CAST(name AS {kind}) AS name", "quality")
    for df in (
        mix.report(docs, key="name"), packing.packed(docs, tokenizer_path(), key="name"), rules.judge(docs, key="name"), exact_dedup.groups(docs, key="name"), substring_dedup.cleaned(docs, key="name"),
        near_dedup.groups(docs, key="name"), lm_ppm.scored(docs, key="name"), quality_gam.scored(docs, labels, key="name"),
    ):
        assert df.schema["doc_id"].dataType.simpleString() == kind and {str(r.doc_id) for r in df.collect()} == set("0123")


def test_labels_of_repeated_keys_are_bounded(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    rows = []
    fit = quality_gam.fit
    try:
        quality_gam.fit = lambda x, y: rows.append(len(y)) or fit(x, y)
        quality_gam.train(docs, labels, rows=4)
    finally:
        quality_gam.fit = fit
    assert rows and 0 < rows[0] <= 4


def test_mix_spreads_keys_in_steps(spark):
    docs = spark.range(2000).selectExpr("id * 256 AS doc_id", "'w' AS text", "'a' AS source")
    assert docs.select(mix.salt_of(docs.doc_id, 64).alias("s")).distinct().count() > 60


# --- empty tables ---------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df in (
        mix.report(empty), mix.mix(empty), packing.packed(empty, tokenizer_path()), rules.judge(empty), rules.passing(empty), exact_dedup.groups(empty), exact_dedup.unique(empty),
        substring_dedup.cleaned(empty), near_dedup.groups(empty), near_dedup.unique(empty), lm_ppm.scored(empty), quality_gam.scored(empty, labels),
    ):
        assert df.count() == 0


# --- rules: distances and verdicts, by brute force ------------------------------------------------------------------

CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[^\\x00-\\x7F]", "[0-9]", "[.,;:'\"()-]", "[!?]", r"[#*$%&|<>=+_~^{}\[\]\\/@`]", "[\\x20\\x09-\\x0D]")]


def histograms(t: str) -> tuple[list[float], list[float], int]:
    classes = [len(c.findall(t)) for c in CLASSES]
    classes.append(len(t) - sum(classes))
    vocab = sorted({w for ws in rules.COMMON.values() for w in ws})
    forms = {f: w for w in vocab for f in (w, w.capitalize(), w.upper())}
    w = split(t)
    n = Counter(forms[x] for x in w if x in forms)
    common = [n[v] for v in vocab] + [len(w) - sum(n.values())]
    share = lambda xs: [x / sum(xs) for x in xs] if sum(xs) else None
    return share(classes), share(common), len(w)


def jensen_shannon(p: list[float], q: list[float]) -> float:
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2 for x, y in zip(p, q, strict=True))))


def test_distances(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    own = {r.doc_id: histograms(r.text) for r in rows}
    langs = {r.doc_id: r.lang for r in rows if r.lang in rules.COMMON and own[r.doc_id][2] >= 40}
    refs: dict = {}
    for bound in (None, *rules.TRIM):
        near = {i: la for i, la in langs.items() if bound is None or all(jensen_shannon(own[i][k], refs[la][k]) <= bound[k] for k in (0, 1))}
        groups = defaultdict(list)
        for i, la in near.items():
            groups[la].append(own[i])
        refs |= {la: tuple([sum(xs) / len(xs) for xs in zip(*(h[k] for h in hs), strict=True)] for k in (0, 1)) for la, hs in groups.items()}
    for r in rules.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        c, v, n = own[r.doc_id]
        classes = min(jensen_shannon(c, q[0]) for q in refs.values()) if len(r.text) >= 40 else None
        common = min(jensen_shannon(v, q[1]) for q in refs.values()) if n >= 40 else None
        assert r.class_distance == pytest.approx(classes, abs=1e-9) and r.common_distance == pytest.approx(common, abs=1e-9)
        a, b = classes or 0.0, common or 0.0
        far = a > (0.27 if len(r.text) >= 300 else 0.60) or b > 0.45 or (a > 0.17 and b > 0.215)
        assert r.kept == (not r.base_failed and not far)
