import random
import time

import numpy as np
from pyspark.sql import functions as F

from mvtrack.llm import common
from mvtrack.llm import fuzzy_lines as S


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_equals_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 30)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("abcé") for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "bé"])
        b = "".join(b)
        d = distance(a, b)
        for most in (d - 1, d, d + 1):
            assert S.within(a, b, most) == (d <= most), (a, b, d, most)


def test_many_pairs_at_once_equal_edit_distance(monkeypatch):
    """Pairs of all lengths, whatever part of them is compared together."""
    rng = random.Random(22)
    lines, pairs = ["", "a", "é\U0001f600"], [(0, 0), (0, 1), (1, 2)]
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcdefgh é", "".join(chr(0x4E00 + k) for k in range(200))])
        a = [rng.choice(alphabet) for _ in range(rng.choice([3, 20, 64, 70, 150, 400]) + rng.randrange(8))]
        b = list(a) if rng.random() < 0.9 else [rng.choice(alphabet) for _ in a]
        for _ in range(int(rng.random() * 0.4 * len(a))):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet)])
        lines += ["".join(a), "".join(b)]
        pairs += [(len(lines) - 2, len(lines) - 1), (len(lines) - 1, rng.randrange(len(lines)))]
    x, y = np.array(pairs).T
    d = [distance(lines[a], lines[b]) for a, b in pairs]
    for similarity in (0.8, 0.5):
        want = [k <= int(max(len(lines[a]), len(lines[b])) * (1 - similarity) + 1e-9) for k, (a, b) in zip(d, pairs, strict=True)]
        assert 50 < sum(want) < len(want) - 50
        for few, cells in ((0, 1 << 22), (0, 1 << 15), (16, 1 << 22), (1 << 20, 1 << 22)):
            monkeypatch.setattr(S, "FEW", few)
            monkeypatch.setattr(S, "CELLS", cells)
            assert S.alike(lines, x, y, similarity).tolist() == want


def test_unlike_lines_are_not_compared_whole():
    """All pairs of lines of one vocabulary: one by one the 19,900 pairs took some 17 s, together they take 0.2 s."""
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    lines = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(200)]
    x, y = np.triu_indices(200, 1)
    began = time.process_time()
    assert not S.alike(lines, x, y, 0.8).any()
    assert time.process_time() - began < 4


def test_long_lines():
    a = "x" * 60_000 + "y" * 60_000
    assert S.within(a, a[:59_000] + "z" * 300 + a[59_000:], 300)
    assert not S.within(a, a[:59_000] + "z" * 300 + a[59_000:], 299)


def test_lines(spark, make_docs, monkeypatch):
    base = " ".join(f"word{k}" for k in range(60))
    near = base.replace("word3 ", "word3, ") + "!"  # the same words
    bits = lambda line: int(S.sketch([line])["fp"][0]) & (1 << 64) - 1
    edits = (base.replace(f"word{k}", f"w{c}rd{k}", 1) for k in range(20, 60) for c in "aeiu")
    edited = next(e for e in edits if (bits(e) ^ bits(base)).bit_count() <= S.RADIUS)  # such pairs must be found
    other = " ".join(f"else{k}" for k in range(60))
    texts = [f"{base}\nshort line\n{other}", f"{near}\nshort line", f"own line of this very document\n{edited}\n{edited}", None, "", other, other, "\n\n"]
    ids = [3, 4, 5, 6, 7, 9, 9, None]
    docs = make_docs(texts, ids).withColumn("n", F.lit("x")).withColumn("first", F.lit(1)).withColumn("keep", F.lit(2))
    for pairwise in (64, 1):
        monkeypatch.setattr(common, "PAIRWISE", pairwise)
        rows = S.drop_repeated_lines(docs).select("doc_id", "text", F.col("__n_lines").alias("lines"), F.col("__n_removed").alias("gone"), "n", "first", "keep").collect()
        got = {(r.doc_id, r.text, r.lines, r.gone) for r in rows}
        assert got >= {(5, "own line of this very document", 3, 2), (3, f"{base}\nshort line\n{other}", 3, 0), (4, "short line", 2, 1), (6, None, 0, 0), (7, "", 1, 0), (9, "", 1, 1), (None, "\n\n", 3, 0)}
        assert len(rows) == 8
    assert S.drop_repeated_lines(docs.limit(0)).count() == 0


def test_groups_equal_brute_force(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{k}x" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)]
    texts = ["\n".join(rng.sample(base, 3) + [" ".join(rng.choice(words) for _ in range(12))]) for _ in range(60)]
    want, seen = [], set()
    for t in texts:
        kept = []
        for line in t.split("\n"):
            if line not in seen:
                kept.append(line)
            seen.add(line)
        want.append("\n".join(kept))
    got = dict(S.drop_repeated_lines(make_docs(texts)).select("doc_id", "text").collect())
    assert [got[i] for i in range(60)] == want


def test_recall_of_lines_with_changed_words(spark, make_docs):
    """Every pair that brute force finds similar, with one or two words changed, added, removed or misspelt."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    kinds = {}
    for size in (6, 10, 20, 40):
        for changes in (1, 2):
            for how in ("typo", "replace", "add", "remove"):
                for _ in range(12):
                    a = [word() for _ in range(size)]
                    b = list(a)
                    for at in sorted(rng.sample(range(size), changes), reverse=True):
                        b[at : at + 1] = {"typo": [b[at][:-1] + "0"], "replace": [word()], "add": [b[at], word()], "remove": []}[how]
                    a, b = " ".join(a), " ".join(b)
                    if len(b.split()) >= 5 and distance(a, b) <= 0.2 * max(len(a), len(b)):
                        kinds.setdefault((size, changes, how), []).append((a, b))
    pairs = [p for own in kinds.values() for p in own]
    texts = [line for p in pairs for line in p]
    assert len(pairs) > 250
    gone = {r.doc_id for r in S.drop_repeated_lines(make_docs(texts)).where("__n_removed = 1").select("doc_id").collect()}
    found = [2 * k + 1 in gone for k in range(len(pairs))]
    assert sum(found) >= 0.98 * len(pairs)
    assert gone <= {2 * k + 1 for k in range(len(pairs))}


def test_lines_of_few_words(spark, make_docs):
    rng = random.Random(8)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    changed = chinese[:20] + "x" + chinese[21:]
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(30))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    menu = "Frequently asked questions"
    texts = [f"{chinese}\n{menu}\nhome\n{thai}", f"{other}\n{menu.upper()}!\nhome", f"{changed}\n{thai}\nhome", "home"]
    rows = {r.doc_id: (r.text, r["__n_removed"]) for r in S.drop_repeated_lines(make_docs(texts)).collect()}
    assert rows == {0: (texts[0], 0), 1: (f"{other}\nhome", 1), 2: ("home", 2), 3: ("home", 0)}


def test_recall_of_one_changed_character(spark, make_docs, monkeypatch):
    """Lines of 5 to 80 words with one character changed, whatever joins are broadcast."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    kinds = {}
    for size in (5, 8, 12, 20, 40, 80):
        for _ in range(40):
            a = " ".join(word() for _ in range(size))
            at = rng.choice([k for k, c in enumerate(a) if c != " "])
            b = a[:at] + rng.choice("0123456789") + a[at + 1 :]
            kinds.setdefault(size, []).append((a, b))
    monkeypatch.setattr(S, "BROADCAST_LINES", 0)
    pairs = [(size, *p) for size, own in kinds.items() for p in own]
    gone = {r.doc_id for r in S.drop_repeated_lines(make_docs([x for _, a, b in pairs for x in (a, b)])).where("__n_removed = 1").select("doc_id").collect()}
    for size in kinds:
        found = [2 * k + 1 in gone for k, (n, _, _) in enumerate(pairs) if n == size]
        assert sum(found) >= 0.95 * len(found), size


def test_script_is_never_below_the_distance():
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 4)))
    for _ in range(500):
        a = [word() for _ in range(rng.randrange(0, 12))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice([[], [word()], [word(), word()]])
        a, b = " ".join(a), " ".join(b)
        assert S._script(a, b) >= distance(a, b)


def test_large_groups_by_hubs_and_whole(spark, make_docs, monkeypatch):
    """Near copies of one line: all pairs, and hubs that lose few of what all pairs connect."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(30)]
    texts = []
    for _ in range(80):
        own = list(base)
        for at in rng.sample(range(30), rng.randrange(0, 5)):
            own[at] = word()
        texts.append(" ".join(own))
    monkeypatch.setattr(common, "PAIRWISE", 4)
    whole = {r.doc_id for r in S.drop_repeated_lines(make_docs(texts), hubs=None).where("__n_removed = 1").collect()}
    hubs = {r.doc_id for r in S.drop_repeated_lines(make_docs(texts)).where("__n_removed = 1").collect()}
    assert hubs <= whole and len(whole) >= 75 and len(hubs) >= 0.95 * len(whole)


def test_meet_lists_every_pair(spark, monkeypatch):
    """Pairs and large groups are all there is, however few rows a task gathers."""
    import numpy as np

    rng = random.Random(20)
    rows = [(n, rng.randrange(10, 12), 1, rng.randrange(1, 30) if rng.random() < 0.7 else 1000 + rng.randrange(5000)) for n in range(1, 600)]
    nodes = spark.createDataFrame(rows, "n long, size int, times long, key long").repartition(5)
    want = {}
    for n, size, _, key in rows:
        want.setdefault(key, []).append((n, size))
    for gathered in (10, 1_000_000):
        monkeypatch.setattr(common, "GATHERED", gathered)
        pairs, hot = common.meet(nodes, lambda b: np.asarray(b.column("key"))[:, None], 0.8, 8)
        got = {(r.src, r.dst) for r in pairs.collect()}
        members = {}
        for r in hot.collect():
            members.setdefault((r.key, r.hub), set()).add(r.n)
        large = {k: {n for n, _ in v} for k, v in want.items() if len(v) > 8}
        assert {k: v for (k, _), v in members.items()} == large
        small = {(min(a, b), max(a, b)) for v in want.values() if len(v) <= 8 for a, _ in v for b, _ in v if a != b}
        assert {p for p in got if p not in {(min(n, h), max(n, h)) for (_, h), v in members.items() for n in v}} <= small <= got


def test_large_groups_lose_no_link(spark, make_docs, monkeypatch):
    """A chain of lines that all share their longest words: neighbours are alike, far ones are not, and no hub is near all."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    long_words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for _ in range(5)]
    own, texts = [word() for _ in range(60)], []
    for k in range(90):
        own[k % 60] = word()
        texts.append(" ".join(long_words + own))
    other = [" ".join(long_words + [word() for _ in range(60)]) for _ in range(20)]  # in the same groups, like nothing
    for block, settled in ((1024, 4096), (16, 40)):
        monkeypatch.setattr(common, "BLOCK", block)
        monkeypatch.setattr(common, "SETTLED", settled)
        gone = {r.doc_id for r in S.drop_repeated_lines(make_docs(texts + other)).where("__n_removed = 1").select("doc_id").collect()}
        assert gone == set(range(1, 90))
