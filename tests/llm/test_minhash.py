import random
import re

from palaver.llm import minhash
from palaver.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def fixture():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    rows, key = [], 0
    for base in range(25):
        words = [word() for _ in range(rnd.choice((3, 5, 8, 60, 200, 900)))]
        for _ in range(rnd.randint(1, 7)):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((key * 3, rnd.choice((" ", "\n", "\t ")).join(copy)))
            if rnd.random() < 0.3:
                words = copy  # chains: the ends needn't link
            key += 1
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "A B c"), (9005, "a b C"), (9006, "a b c d"), (9007, "a\xa0b c")]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    rnd = random.Random(1)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as band", "2 as component_id")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert out == brute(rows)


def test_repeated_and_missing_rows(spark):
    a, b = ([f"{k}{i}" for i in range(40)] for k in "ab")
    near = lambda words: " ".join(["other", *words[1:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (5, near(a)), (6, near(b)), (7, None), (7, "x y"), (8, "x y"), (None, "x y"), (None, None)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as rep")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
        assert got == sorted([(1, 36, 1, True)] * 3 + [(5, 36, 1, False), (6, 36, 1, False), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 1, None, False), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (100, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


def test_second_look_finds_links_past_the_first_class(spark):
    """Copies that are too far from the smallest one, some of them near to each other."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(words)
        for _ in range(rnd.choice((2, 5, 7, 8))):
            copy[rnd.randrange(150)] = f"x{rnd.random()}"
        rows.append((i, " ".join(copy)))
        if i % 5 == 0:
            copy[rnd.randrange(150)] = "y"
            rows.append((100 + i, " ".join(copy)))
    old, minhash.BLOCK = minhash.BLOCK, 10
    try:
        out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        minhash.BLOCK = old
    want = brute(rows)
    assert out == want and 3 < sum(k for _, _, k in want.values()) < 60


def test_blocks_keep_pairs_whose_short_members_collide():
    import numpy as np
    import pyarrow as pa

    def block(doc, members):
        short = (np.array(members, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes()
        return [{"doc_id": doc, "component": doc, "n_shingles": len(members), "members": short}]

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("component", pa.int64()), ("n_shingles", pa.int64()), ("members", pa.binary())]))
    # three of four members are shared, exactly 75 %, two of them with equal upper halves
    x, y = [(5 << 32) + 1, (5 << 32) + 2, 9 << 32], [(5 << 32) + 1, (5 << 32) + 2, 9 << 32, 11 << 32]
    z = [5 << 32, 13 << 32, 14 << 32, 15 << 32]
    left, right = ([block(1, x), block(1, x)], [block(2, y), block(3, z)])
    batch = pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["x", "y"])
    (out,) = minhash._compare_blocks([batch])
    assert out.to_pylist() == [{"a": 1, "b": 2}]
