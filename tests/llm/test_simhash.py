"""SimHash against plain loops over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from lumatab.llm import shared, simhash
from lumatab.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "A b C d", "Ärger ÄRGER x\x0by z É", "a b c d e f " * 50, "x\x85y \xa0 z w v"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_print(text)


def test_near_lanes_all_radii():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 1, dtype=np.int64)[0]
    values = np.array([int(base) ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, 9), replace=False)) for _ in range(300)], np.int64)
    planes = simhash._planes(values, 5)
    for radius in range(5):
        for shift in (1, 2, 63, 64, 65, 130, 299):
            ok = np.zeros(320, bool)
            ok[: 300 - shift] = True
            got = np.unpackbits(simhash.near_lanes(planes, shift, np.packbits(ok, bitorder="little").view("<u8"), radius).view(np.uint8), bitorder="little")
            want = [bin((int(values[i]) ^ int(values[i + shift])) & (2**64 - 1)).count("1") <= radius for i in range(300 - shift)]
            assert got[: 300 - shift].tolist() == want


def spread(seed, n):
    """Fingerprints with close ones at every distance up to 6."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        out.append(r.choice(out) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("count, bucket_rows", [(10, 2048), (10**9, 2048), (10, 6)])
def test_links(spark, count, bucket_rows):
    values = sorted(set(spread(count, 500)))
    with shared.steps(spark) as tables:
        edges = simhash.near_edges(spark.createDataFrame([(v,) for v in values], "fp long"), count, tables, bucket_rows=bucket_rows)
        got = plain_components([tuple(e) for e in edges.collect()], values)
    want = plain_components([(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4], values)
    assert got == want


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(400)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    with shared.steps(spark) as tables:
        got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long"), tables).collect()))
        assert got == plain_components(pairs, nodes)
        assert connected_components(spark.createDataFrame([], "a long, b long"), tables).count() == 0


def test_whole_operator(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, r.choice(base)) for i in range(30)] + [(200, None), (201, ""), (None, base[3]), (7, base[9]), (7, base[7])]
    for i in range(20):
        w = r.choice(base).split()
        if w:
            w[r.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    prints = [plain_print(t) for _, t in rows]
    comp = plain_components([(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4], set(prints))
    first = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[comp[p]] = min(i, first.get(comp[p], i))
    want = sorted((repr(i), f"{p:016x}", first.get(comp[p])) for (i, _), p in zip(rows, prints))
    got = simhash.near_duplicates(docs.withColumnRenamed("lang", "fp").withColumnRenamed("source", "id"))
    assert sorted((repr(x.doc_id), x.fingerprint, x.component_id) for x in got.collect()) == want
    stay = simhash.deduplicated(docs.withColumnRenamed("lang", "fp").withColumnRenamed("source", "id").union(docs))
    assert stay.columns == ["doc_id", "text", "fp", "id", "n_chars"]
    kept = stay.collect()
    assert len(kept) == len(set(comp.values()))
    assert len({comp[plain_print(x.text)] for x in kept}) == len(kept)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicated(docs.limit(0)).count() == 0
