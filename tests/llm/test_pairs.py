"""Operators that relate documents, lines, vectors or strings, against plain comparisons of all with all."""

import gc
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docloom.llm import embeddings, lines, repeats, simhash
from docloom.llm.common import stored
from docloom.llm.components import components

DOCS = "doc_id long, text string, fp int, key int, component string, id int, n_chars long"


def docs(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "c", 3, len(t or "")) for i, t in rows], DOCS)


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (-3, 500), (501, 500)]
    rnd.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in links if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(rnd, n):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, 4)):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            out.append(" ".join(own))
    return out


def test_simhash(spark):
    rnd = random.Random(5)
    texts = [*near_texts(rnd, 80), None, "", " \n", "One", "one two", "ONE  two", "long text " * 20_000]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    for r in got:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(docs(spark, [*rows, (None, "One")]))
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, set(want.values())), *(["3"] if want[3] == 3 else []), "None"])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_simhash_finds_every_pair_within_three_bits(spark):
    rnd = random.Random(6)
    fps = set()
    for _ in range(200):
        x = rnd.getrandbits(64)
        fps.add(x)
        for k in (1, 2, 3, 4):
            y = x
            for b in rnd.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (x >> 63 << 64) for x in fps]
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3 for r in edges)
    assert roots(signed, [(r["a"], r["b"]) for r in edges]) == roots(signed, pairs)
    with pytest.raises(ValueError):
        simhash.near_edges(spark.createDataFrame([], "fp long"), 4)


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
        d = e
    return d[-1]


def test_edit_similarity():
    rnd = random.Random(7)
    for _ in range(3000):
        a = bytes(rnd.choices(b"abc ", k=rnd.randint(0, 25)))
        b = bytearray(a)
        for _ in range(rnd.randint(0, 6)):
            b[rnd.randint(0, len(b)) : rnd.randint(0, len(b))] = bytes(rnd.choices(b"abc", k=rnd.randint(0, 2)))
        longer = max(len(a), len(b))
        assert lines.edit_similar(a, bytes(b)) == (plain_distance(a, b) <= int(0.2 * longer + 1e-9))


def plain_line_fingerprint(line):
    """N-gram by n-gram: what lines.fingerprints does for many lines at once."""
    bits = [0] * 64
    for k in range(len(line) - 3):
        w, x, y, z = (c + 1 for c in line[k : k + 4])
        p = 0x100000001B3
        h = ((w * p + x) * p * p + y * p + z) % (1 << 64)
        h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % (1 << 64)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 32
        for b in range(64):
            bits[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if bits[b] > 0)


def test_line_fingerprints():
    rnd = random.Random(22)
    texts = [" ".join("".join(rnd.choices("abcdeé汉", k=rnd.randint(1, 20))) for _ in range(rnd.randint(1, 30))).encode() for _ in range(60)]
    texts += [b"a", b"", b"abcd", b"ab " * 9000 + b"c", b"", b"x" * 259, b"abc"]
    assert lines.fingerprints(texts).tolist() == [plain_line_fingerprint(x) for x in texts]
    assert lines.fingerprints([]).tolist() == []


def test_least_hashes():
    rnd = random.Random(23)
    for _ in range(40):
        texts = [[rnd.randrange(rnd.choice([20, 1 << 30, 1 << 44])) << 20 for _ in range(rnd.choice([0, 1, 9, 90, 400]))] for _ in range(9)]
        # some bytes after each line start no n-gram of it
        after = [0, 0, 0]
        sizes = np.array([len(x) for x in texts])
        got = lines._least(np.array([g for x in texts for g in [*x, *after]], np.uint64), np.cumsum(sizes + 3) - sizes - 3, sizes)
        for i, grams in enumerate(texts):
            want = {g: grams.index(g) if grams.count(g) == 1 else -1 for g in sorted(set(grams))[: lines.KEYS]}
            assert {int(h): int(at) for line, h, at in zip(*got, strict=True) if line == i} == want


@pytest.mark.parametrize("part", [2, 20_000])
def test_lines(spark, monkeypatch, part):
    monkeypatch.setattr(lines, "PART", part)
    rnd = random.Random(8)
    pool = [x for t in near_texts(rnd, 25) for x in (t, t.upper() + "!!")] + ["a b", "", "x"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))) for i in range(60)] + [(60, None), (61, ""), (62, "one two three four five " * 9000)]
    # every line that is judged, by where it stands
    occurrences = [(i, k, lines.normal(x)) for i, t in rows for k, x in enumerate((t or "").encode().split(b"\n")) if lines.normal(x)]
    first = {}
    for i, k, x in occurrences:
        first.setdefault(x, (i, k))
    texts = sorted(first, key=first.get)
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if lines.edit_similar(texts[a], texts[b])]
    root = roots(range(len(texts)), near)
    place = {x: n for n, x in enumerate(texts)}
    gone = {(i, k) for i, k, x in occurrences if (i, k) != first[texts[root[place[x]]]]}
    out = {r["doc_id"]: r for r in lines.without_repeats(docs(spark, rows)).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        assert out[i]["__text"] == "\n".join(kept)
    same = lines.deduplicated(docs(spark, [*rows, (None, "one two three four five six\none two three four five six")]))
    assert same.columns == docs(spark, []).columns
    for r in same.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["doc_id"] is not None or r["text"].count("\n") == 1
    assert lines.deduplicated(docs(spark, [])).collect() == []


def changed(rnd, line, share):
    """A line with so large a share of its characters changed, left out or put in, wherever it falls."""
    b = bytearray(line)
    for _ in range(max(1, int(share * len(line)))):
        p = rnd.randrange(len(b) + 1)
        b[p : p + rnd.randint(0, 1)] = rnd.choices(b"abcdefghij", k=rnd.randint(0, 1))
    return bytes(b)


def test_lines_meet_all_that_edit_similarity_links(spark):
    """Against edit similarity alone: all copies with one letter changed, most with a tenth of their characters changed wherever they fall."""
    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(500)]
    rows = []
    for n in [*range(5, 13), *range(13, 61, 4), 100, 200] * 6:
        line = " ".join(rnd.choices(words, k=n)).encode()
        p = rnd.choice([i for i, c in enumerate(line) if c != 32])
        rows += [(len(rows), line), (len(rows) + 1, line[:p] + b"z" + line[p + 1 :]), (len(rows) + 2, changed(rnd, line, 0.1))]
    texts = [lines.normal(x) for _, x in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if lines.edit_similar(texts[i], texts[j])]
    want = roots(range(len(rows)), near)
    got = {r["doc_id"]: r["__n_removed"] for r in lines.without_repeats(docs(spark, [(i, x.decode()) for i, x in rows])).collect()}
    assert all(got[i] == int(want[i] != i) for i in want if i % 3 < 2)
    missed = sum(got[i] != int(want[i] != i) for i in want if i % 3 == 2)
    assert missed <= 0.1 * len(rows) / 3  # 5 % when last counted


def levenshtein(a, b):
    """Row by row: the operator's own distances aren't asked."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        left = [i]
        for j, d in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (c != d)))
        row = left
    return row[-1]


def test_single_pairs_of_lines(spark):
    """Recall of pairs by plain edit distance: 60 to 400 bytes, 2 to 15 % of them replaced, put in or left out at random places."""
    rnd = random.Random(29)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(2000)]
    pairs = []
    for size in (60, 90, 120, 200, 300, 400):
        for share in (0.02, 0.05, 0.1, 0.15):
            for _ in range(12):
                a = lines.normal(" ".join(rnd.choices(words, k=size // 2))[:size].encode())
                b = bytearray(a)
                for p in rnd.sample(range(len(a)), int(share * len(a))):
                    b[p] = rnd.choice([c for c in b"abcdefghijklmnopqrstuvwxyz" if c != a[p]])
                if rnd.random() < 0.3:
                    p = rnd.randrange(len(b))
                    b[p : p + rnd.randint(0, 2)] = b"qz"[: rnd.randint(0, 2)]
                pairs.append((share, a, lines.normal(bytes(b))))
    pairs = [(share, a, b) for share, a, b in pairs if a != b and levenshtein(a, b) <= 0.2 * max(len(a), len(b))]
    assert len(pairs) >= 280
    rows = [(i, f"{a.decode()}\n{b.decode()}") for i, (_, a, b) in enumerate(pairs)]
    got = {r["doc_id"]: r["__n_removed"] for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert set(got.values()) <= {0, 1}
    found = {share: [got[i] for i, p in enumerate(pairs) if p[0] == share] for share in (0.02, 0.05, 0.1, 0.15)}
    assert sum(got.values()) >= 0.9 * len(pairs)
    assert all(sum(found[s]) >= least * len(found[s]) for s, least in ((0.02, 1), (0.05, 0.98), (0.1, 0.9), (0.15, 0.7)))


def test_edit_similarity_of_long_lines():
    rnd = random.Random(30)
    assert lines.edit_similar(b"abcdefghij" * 30, b"abcdefgxij" * 30)
    seen = set()
    for _ in range(60):
        a = bytes(rnd.choices(b"abcdef ", k=rnd.randint(257, 420)))
        b = bytearray(a)
        for _ in range(int(rnd.uniform(0.1, 0.3) * len(a))):
            p = rnd.randrange(len(b))
            b[p : p + rnd.randint(0, 1)] = rnd.choices(b"abcdef ", k=rnd.randint(0, 1))
        near = levenshtein(a, bytes(b)) <= 0.2 * max(len(a), len(b))
        seen.add(near)
        assert lines.edit_similar(a, bytes(b)) == near
    assert len(seen) == 2


def test_short_lines_and_lines_without_spaces(spark):
    chinese = "这个合同自双方签字之日起生效并且一直有效直到双方另有书面约定"
    rows = [(1, f"Yes\n{chinese}\n---\n"), (2, f"yes!\n{chinese}\n---\n"), (3, f"read more\n{chinese[:-1]}点"), (4, "Read more\nno"), (5, "ราคานี้รวมภาษีแล้ว\nok"), (6, "ราคานี้รวมภาษีแล้ว\non")]
    got = {r["doc_id"]: r["__text"] for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "---\n", 3: "read more", 4: "no", 5: rows[4][1], 6: "on"}


def plain_repeats(rows, length):
    """Of every document: bytes covered by strings of the length that start twice, and what is left."""
    starts = {}
    data = {n: (t or "").encode() for n, (_, t) in enumerate(rows)}
    for n, x in data.items():
        for p in range(len(x) - length + 1):
            starts.setdefault(x[p : p + length], []).append((n, p))
    covered = {n: bytearray(len(x)) for n, x in data.items()}
    for found in starts.values():
        if len(found) > 1:
            for n, p in found:
                covered[n][p : p + length] = b"\1" * length
    out = []
    for n, (i, _) in enumerate(rows):
        c = covered[n]
        out.append((i, len(c), sum(c), sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1])), hashlib.sha256(bytes(x for x, y in zip(data[n], c, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "most"), [(200, 2000), (60, 2000), (60, 2), (200, 1)])
def test_repeats(spark, monkeypatch, length, most):
    monkeypatch.setattr(repeats, "MOST", most)  # anchors with more texts are split
    rnd = random.Random(length + most)
    words = ["".join(rnd.choices("abcdefghé", k=rnd.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    passages = [say(rnd.randint(8, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else say(rnd.randint(1, 60)))
            if rnd.random() < 0.2:
                parts[-1] = parts[-1][rnd.randint(0, 40) : len(parts[-1]) - rnd.randint(0, 40)]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[0][1]), (71, rows[0][1][5:]), (72, None), (73, ""), (74, "a" * 3000), (75, "ab" * 500), (76, "x" * length), (77, "y" * (length - 1)), (78, "z" * (length + 1)), (None, say(100)), (79, rows[3][1]), (79, rows[3][1])]
    got = repeats.without_repeats(docs(spark, rows), length).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)
    assert found == plain_repeats(rows, length)


def test_repeats_of_text_ids(spark):
    say = "".join(random.Random(3).choices("abcdefg ", k=400))
    rows = [("x1", say), ("x2", "y" + say), (None, None), ("x1", "short")]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == [("None", 0, 0), ("x1", 5, 0), ("x1", 400, 400), ("x2", 401, 400)]


def test_repeats_of_long_texts(spark):
    rnd = random.Random(11)
    long = "".join(rnd.choices("abcdefghij ", k=2_600_000))
    part = long[1_048_500:1_049_300]  # across a border of what is hashed at once
    rows = [(1, long), (2, "".join(rnd.choices("xyz", k=300)) + part)]
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs(spark, rows)).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"], got[2]["n_spans"]) == (800, 1, 800, 1)
    assert repeats.without_repeats(docs(spark, [])).collect() == []


def test_maximal_repeats():
    rnd = random.Random(12)
    for _ in range(300):
        base = [bytes(rnd.choices(b"ab", k=12)) for _ in range(3)]
        contexts = [(rnd.choice(base)[: rnd.randint(0, 12)], b"#" + rnd.choice(base)[: rnd.randint(0, 12)]) for _ in range(rnd.randint(1, 9))]
        got = repeats.maximal_repeats(contexts, 6)
        for i, (left, right) in enumerate(contexts):
            reach = {(repeats._common(left, a), repeats._common(right, b)) for j, (a, b) in enumerate(contexts) if j != i}
            want = {(p - k, p - k + 6) for a, b in reach for p in [0] for k in range(a + 1) if b + k >= 6}
            mine = {(-k, 6 - k) for a, b, members in got if i in members for k in range(a + 1) if b + k >= 6}
            assert mine == want


VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, n int, h1 int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "v", 2, 3) for i, v, y in rows], VECTORS)


@pytest.mark.parametrize("block", [5, 1000])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(13)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.3])).astype(np.float32).tolist(), int(c % 3)))
    for k in range(20):
        rows.append((len(rows), rows[0][1], 0))
    n = len(rows)
    nan = float("nan")
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [nan] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [float("inf")] * 16, 1), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    got = embeddings.near_duplicates(vectors(spark, rows + odd)).collect()
    assert len(got) == n + len(odd)
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (same[:, None] == same[None, :])
    np.fill_diagonal(close, False)
    want = roots(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True)])
    for r in got:
        i = r["vec_id"]
        if i is not None and i < n:
            assert (r["n_links"], r["component_id"], r["kept"]) == (int(close[i].sum()), want[i], want[i] == i)
        elif i in (n + 7, n + 8):
            assert (r["n_links"], r["component_id"]) == (1, n + 7)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []


def test_embeddings_need_the_join_of_neighbours(spark, monkeypatch):
    """On crowded vectors two small windows alone lose components; neighbours of neighbours find them."""
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(1, 24)) + 0.25 * rng.normal(size=(150, 24))
    x = np.repeat(centres, 4, axis=0) + 0.06 * rng.normal(size=(600, 24))
    monkeypatch.setattr(embeddings, "SETS", 2)
    monkeypatch.setattr(embeddings, "NEAR", 12)
    monkeypatch.setattr(embeddings, "OVERLAP", 6)
    rows = vectors(spark, [(i, v, 0) for i, v in enumerate(x.tolist())])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    want = roots(range(600), [(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True)])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(rows).collect()}
    assert sum((r["n_links"], r["component_id"]) != (int(close[i].sum()), want[i]) for i, r in got.items()) <= 6
    own = rows.select(embeddings.F.lit(0).cast("long").alias("part"), embeddings.F.col("vec_id").alias("id"), embeddings.F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    unit = own.withColumn("v", embeddings.F.transform("v", lambda v: v / embeddings.F.sqrt(embeddings.F.aggregate("v", embeddings.F.lit(0.0), lambda a, y: a + y * y))))
    first = stored(embeddings._first_graph(unit, [0, 1], 0.98).distinct(), "first")
    found = lambda e: e.where("sim >= 0.98").select("a", "b").distinct().count()
    assert found(embeddings._refined(first, unit, 0.98, 10, 0).unionByName(first)) > 1.1 * found(first)


def test_embeddings_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = embeddings.near_duplicates(vectors(spark, [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (4, b, 0)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_stored_outlives_its_source(spark):
    df = stored(spark.range(5).toDF("a"), "x")
    assert sorted(r["a"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_vectors_of_any_size(spark):
    """Squares of very large and very small components don't fit a double; directions decide all the same."""
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e200, 1e200, 0.0]), (3, [2e200, 2e200, 0.0]), (4, [1e-200, 1e-200, 0.0]), (5, [1e-200, 1e-200, 0.0]), (6, [1.0, 1.0, 0.0]), (7, [0.0, 0.0, 0.0]), (8, [1e200, float("inf"), 0.0]), (9, [1.0, float("nan"), 1.0]), (10, [1.0, None, 1.0]), (11, [-1.0, -1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (5, 1) if i <= 6 else (0, i) for i, _ in rows}


def _prose(rnd, size):
    """Words of few syllables, as unlike lines of one language share many n-grams."""
    syllables = "the and ing tion er re on an st ou le en de".split()
    return " ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(size)).encode()


def test_unlike_lines_cost_no_edit_distance(monkeypatch):
    """Lines that meet by chance are told apart by bounds of their distance, and no bound denies a link."""
    rnd = random.Random(8)
    texts = [lines.normal(_prose(rnd, rnd.choice([12, 40, 90]))) for _ in range(60)]
    for a in texts[:12]:
        for share in (0.02, 0.1, 0.18, 0.25):
            b = bytearray(a)
            for _ in range(int(share * len(a))):
                k = rnd.randrange(len(b))
                b[k : k + 1] = rnd.choice([b"", b"q", b"zx"])
            texts.append(bytes(b))
    sizes = np.array([len(x) for x in texts])
    near = {(i, j): plain_distance(texts[i], texts[j]) <= int(0.2 * max(sizes[i], sizes[j]) + 1e-9) for i in range(60, len(texts)) for j in range(60 // 5)}
    profiles = lines._profiles(texts, int(sizes.max()))
    for (i, j), want in near.items():
        assert lines.edit_similar(texts[i], texts[j]) == want
        assert not want or lines._may_be_similar(profiles[[i]], sizes[[i]], profiles[j], sizes[j])[0]
    assert any(near.values())
    assert all(lines._common(a, b) == _plain_common(a, b) for a, b in zip(texts[:4], texts[60:64], strict=True))

    counted = []
    monkeypatch.setattr(lines, "_many_edits", lambda a, b, most: counted.append(1) or False)
    group = [(k, 0, -1, x) for k, x in enumerate(lines.normal(_prose(rnd, 60)) for _ in range(40))]
    assert lines._links_of(group) == []
    assert not counted


def _plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_small_groups_step_together():
    """The groups of many keys at once, against one after the other."""
    rnd = np.random.default_rng(3)
    counts = np.array([3, 70, 4, 40, 64, 65, 9] + [5] * 50)
    starts = np.cumsum(counts) - counts
    n = counts.sum()
    sims = (rnd.integers(0, 1 << 62, 6)[rnd.integers(0, 6, n)] ^ (1 << rnd.integers(0, 60, n))).astype(np.int64)
    rows = np.stack([np.repeat(np.arange(len(counts)), counts), rnd.integers(0, 1 << 40, n), sims, rnd.integers(80, 130, n), rnd.integers(-1, 40, n)])
    got = {(s, frozenset(m.tolist()), m[0], dense) for s, m, dense in lines._stars_of(rows, starts, counts)}
    want = {(s, frozenset(s + k for k in m), s + m[0], dense) for s, c in zip(starts.tolist(), counts.tolist(), strict=True) for m, dense in lines._star_of(rows[2, s : s + c].view(np.uint64), rows[3, s : s + c], rows[4, s : s + c])}
    assert got == want and len(want) > 20


def test_pairs_of_lines_are_judged_together_as_one_by_one():
    rng = random.Random(11)
    texts = []
    for size in (3, 20, 63, 64, 65, 128, 200, 330, 700, 2100):
        for _ in range(6):
            base = bytes(rng.choice(b"abcde ") for _ in range(size))
            texts.append(base)
            for share in (0.1, 0.19, 0.22, 0.3):
                other = bytearray(base)
                for _ in range(int(share * size)):
                    k, kind = rng.randrange(len(other) + 1), rng.randrange(3)
                    other[k : k + (kind > 0)] = b"" if kind == 1 else bytes([rng.choice(b"xyz")])
                texts.append(bytes(other) or b"a")
    of = np.arange(len(texts))
    near = np.abs(of[:, None] - of) < 5
    a, b = np.nonzero(near & (of[:, None] != of))
    want = [lines.edit_similar(texts[i], texts[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    calls = []
    single = lines.edit_similar
    lines.edit_similar = lambda x, y: calls.append((x, y)) or single(x, y)
    try:
        got = lines.similar_pairs(lines._Lines(texts), a, b)
    finally:
        lines.edit_similar = single
    assert got.tolist() == want and 0.1 < np.mean(want) < 0.9
    assert len(calls) < len(a) / 3  # the longest, and those of a size that few have


def test_links_of_a_task_are_looked_for_together(monkeypatch):
    """Comparisons of few pairs cost as much as those of thousands, so groups of tens of thousands of lines wait for each other; more don't, and none is left."""
    calls, rnd = [], random.Random(5)
    found = lines._links_among
    monkeypatch.setattr(lines, "_links_among", lambda groups: calls.append(sum(map(len, groups))) or found(groups))
    rows = []
    for g in range(6_000):
        line = "".join(rnd.choices("abcdefgh ", k=40))
        rows += [(g, 0, 0, 2 * g + k, 0, -1, f"{line}{'x' * k}".encode()) for k in range(2)]
    cols = dict(zip(("g", "i", "j", "h1", "sim", "place", "norm"), zip(*rows, strict=True), strict=True))
    batch = pa.RecordBatch.from_pydict({k: list(v) for k, v in cols.items()})
    links = lambda: sorted((a, b) for x in lines._links(iter(batch.slice(at, 500) for at in range(0, len(rows), 500))) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True))
    want = [(2 * g, 2 * g + 1) for g in range(6_000)]
    assert [tuple(sorted(x)) for x in links()] == want and [n for n in calls if n] == [12_000]
    monkeypatch.setattr(lines, "GROUPED", 5_000)
    assert [tuple(sorted(x)) for x in links()] == want and len([n for n in calls if n]) == 4


def test_links_of_many_groups_connect_what_plain_comparisons_do():
    rng, rows, groups = random.Random(5), {}, []
    for n in (2, 2, 3, 9, 40, 90):
        bases, group = [bytes(rng.choice(b"abcdefg ") for _ in range(rng.choice((40, 90, 150)))) for _ in range(max(1, n // 6))], []
        for _ in range(n):
            text = bytearray(rng.choice(bases))
            for _ in range(len(text) // 12):
                text[rng.randrange(len(text))] = rng.choice(b"uvwxyz")
            h1 = len(rows)
            rows[h1] = bytes(text)
            group.append((h1, int(lines.fingerprints([bytes(text)])[0].astype(np.int64)), -1, bytes(text)))
        groups.append(group)
    want = []
    for group in groups:
        sims, sizes, places = np.array([x[1] for x in group], np.int64).view(np.uint64), np.array([len(x[3]) for x in group]), np.full(len(group), -1)
        for i in range(len(group)):
            ok = lines._may_link(sims, sizes, places, sims[i], sizes[i], places[i])
            want += [(group[i][0], group[j][0]) for j in range(i) if ok[j] and lines.edit_similar(group[i][3], group[j][3])]
    got = lines._links_among(groups)
    assert roots(rows, got) == roots(rows, want) and {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in want}
    assert len(set(roots(rows, got).values())) < len(rows)


def test_keys_of_lines_leave_no_arrays_behind():
    """What one batch of lines took is free before the next, without a search for cycles."""
    rnd = random.Random(51)
    texts = [lines.normal(_prose(rnd, 60)) for _ in range(100)]
    lines._keys_of(texts)
    gc.disable()
    try:
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(5):
            lines._keys_of(texts)
            lines.fingerprints(texts)
        left = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
        gc.enable()
    assert left < 100_000
