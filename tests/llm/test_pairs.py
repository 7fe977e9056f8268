"""Near-duplicates, history, leakage: against brute force on small made-up texts."""

import random
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm import history
from foliospark.llm.history import sha256_value
from foliospark.llm.leakage import LeakageSearch
from foliospark.llm.neardup import NearDuplicates

WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def shingles(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def overlap(a, b, n):
    x, y = shingles(a, n)[0], shingles(b, n)[0]
    return len(x & y) / len(x | y) if x | y else 0


def texts(seed, n, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(length // 2, length * 2))) for _ in range(n)]
    for i in range(n):
        words = out[i % n].split()
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n", ", "]).join(words))
    return out


@pytest.mark.parametrize("hot", [64, 2])
def test_pairs_equal_brute_force(spark, hot):
    t = texts(1, 60)
    rows = [(f"c{i:03}", x, "x", 0) for i, x in enumerate(t)] + [("c000", t[0], "x", 0), ("null", None, "x", 0), ("tiny", "a b c", "x", 0), ("long", " ".join(t), "x", 1), (None, t[1], "x", 0)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, fp string, id int")
    near = NearDuplicates(shingle=3, similarity=0.6, min_words=30, hot=hot)
    got = {tuple(r) for r in near.pairs(df, "chunk_id", "chunk_text").collect()}
    kept = {i: x for i, x, *_ in rows if i and x and shingles(x, 3)[1] >= 30}
    assert got == {(a, b) for a, b in combinations(sorted(kept), 2) if overlap(kept[a], kept[b], 3) >= 0.6} and len(got) > 20


def test_hot_copies_and_groups(spark):
    base = texts(2, 1, 80)[0]
    rows = [(f"h{i:03}", base) for i in range(150)] + [(f"v{i:03}", base.replace("w1", f"z{i}", 1)) for i in range(80)] + [("other", " ".join(f"q{i}" for i in range(50)))]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {r.id: r for r in NearDuplicates(shingle=3, similarity=0.6, hot=8).groups(df, "id", "t").collect()}
    assert len(got) == 231 and {got[i].class_id for i, _ in rows[:-1]} == {"h000"} and got["other"].class_id == "other"
    assert got["h000"].copies == 150 and got["h000"].links == len({x for _, x in rows[:-1]}) - 1 and got["other"].links == 0


@pytest.mark.parametrize("hot, block, crowd", [(16, 2048, 10_000), (4, 16, 20)])
def test_every_pair_of_a_bucket_is_met(spark, hot, block, crowd):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(250):
        n = rng.randint(30, 102)
        at = rng.randint(0, len(base) - n)
        rows.append((i, " ".join(base[at : at + n])))
    df = spark.createDataFrame(rows, "id long, t string")
    near = NearDuplicates(shingle=3, similarity=0.6, hot=hot, block=block, crowd=crowd)
    keys = {r.id: set(r["keys"]) for r in near.signatures(df, "id", "t").collect()}
    keys = {i: keys[i] or next(keys[j] for j, x in rows if x == t and keys[j]) for i, t in rows}
    sets = {i: shingles(t, 3)[0] for i, t in rows}
    wanted = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 and keys[a] & keys[b]}
    got = {tuple(r) for r in near.pairs(df, "id", "t").collect()}
    assert len(wanted) > 3000 and got == wanted, (len(wanted), len(wanted - got), len(got - wanted))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, t string")
    assert NearDuplicates().pairs(none, "id", "t").count() == 0 and NearDuplicates().groups(none, "id", "t").count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    m = spark.createDataFrame([], "record_id long, batch_no int, document_id string, file_hash string, status string")
    c = spark.createDataFrame([], "chunk_id string, document_id string, chunk_text string, metadata struct<chunk_index:int>")
    assert history.check(m, c).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 3), (7, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [*range(1, 41), 60]} == {1} and got[101] == 100


def test_hashes(one):
    assert [one(sha256_value, x) for x in (" SHA256:AbC ", "abc", "sha-256 = abc", "", None, " ")] == ["abc", "abc", "abc", None, None, None]


def test_history_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    t = texts(4, 25, 80)
    chunks, docs = [], {}
    for i, x in enumerate(t):
        words, at, k = x.split(" ") if " " in x else x.split(), 0, 0
        parts = []
        while at < len(words):
            n = rng.choice([0, 1, 1, 2, 30])
            parts.append(" ".join(words[at : at + n]) if n else rng.choice([None, " "]))
            at += n
        docs[f"d{i}"] = " ".join(p or "" for p in parts)
        chunks += [(f"d{i}-{k}", f"d{i}", p, (k * 200,)) for k, p in enumerate(parts)]
    chunks += rng.sample(chunks, 40)
    status = ["success", " SUCCESS", "unsuccessful", "failed", None]
    records = [(i, rng.randint(0, 3), f"d{rng.randrange(len(t) + 3)}", rng.choice(["H1", " sha256:h1 ", "h2", "h3", "", None, f"u{i}"]), rng.choice(status)) for i in range(120)]
    m = spark.createDataFrame(records + records[:5], "record_id long, batch_no int, document_id string, file_hash string, status string")
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, chunk_text string, metadata struct<chunk_index:int>")
    wanted = {}
    order = sorted(records, key=lambda r: (r[1], r[0]))
    clean = lambda h: (h or "").strip().lower().removeprefix("sha256:") or None
    for n, r in enumerate(order):
        if r[1] >= 1:
            wanted[r[0]] = next((e[0] for e in order[:n] if (e[4] or "").strip().lower() == "success" and (clean(r[3]) and clean(r[3]) == clean(e[3]) or r[2] != e[2] and r[2] in docs and e[2] in docs and min(shingles(docs[r[2]], 3)[1], shingles(docs[e[2]], 3)[1]) >= 30 and overlap(docs[r[2]], docs[e[2]], 3) >= 0.6)), None)
    assert sum(v is not None for v in wanted.values()) > 20
    assert {r.record_id: r.earlier_record_id for r in history.check(m, c, shingle=3, similarity=0.6, min_words=30, wave=1).collect()} == wanted
    # batch by batch into one index at a path: a call is given no text but its own documents', and the same call twice changes nothing
    path, got = str(tmp_path / "index"), {}
    for k in (0, 1, 2):
        now = m.where(f"batch_no = {k}" if k < 2 else "batch_no >= 2")
        own = c.join(now.select("document_id").distinct(), "document_id", "left_semi").select(c.columns)
        for _ in range(2 if k == 2 else 1):
            got |= {r.record_id: r.earlier_record_id for r in history.HistoryIndex(spark, path, 3, 0.6, 30).ingest(now, own).collect()}
    assert got == wanted


def test_leakage(spark):
    passage = "Explain why Foozle needs a convex basin when 42 readings arrive, and how Barzle limits it in the end of the long day."
    other = passage.replace("Foozle", "Quxle").replace("42", "77").replace("Barzle", "Wimble")
    cut = " ".join(passage.split()[:12])
    docs = [(1, f"Before. {passage.upper()} After."), (2, f"x {other} y"), (3, cut), (4, None), (5, passage.replace("con", "con­").replace(" a ", " *a*\n")), (6, ""), (1, f"Before. {passage.upper()} After.")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item string")
    p = spark.createDataFrame([(7, passage), (8, None), (9, "short one")], "item_id long, text string")
    rows = {r.doc: r for r in LeakageSearch(p).search(df).collect()}
    assert {k for k, r in rows.items() if r.verbatim} == {1, 5} and rows[2].verbatim == 0 and rows[2].consistent and 3 not in rows
    assert LeakageSearch(p.where("false")).search(df).count() == 0 and LeakageSearch(p).search(df.where("false")).count() == 0


def test_templates_are_judged_by_run(spark):
    passage = "Explain why Foozle needs a convex basin when 42 readings arrive and how Barzle limits it in the end"
    new = lambda a, b: passage.replace("42", a).replace("Foozle", b)
    listed = "put the box at 3 kg then put the box at 5 kg then put the box at 8 kg and go home with it"
    docs = [(1, f"{new('5', 'Quxle')} so x {new('9', 'Wimble')}"), (2, f"{' '.join(passage.split()[:14])} so x {new('9', 'Wimble')}"), (3, listed.replace("3", "4").replace("5", "6").replace("8", "9")), (4, passage), (5, listed), (6, new("9", "Barzle"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame([(7, passage), (8, listed)], "item_id long, text string")
    assert {(r.doc, r.item) for r in LeakageSearch(p).templates(df).collect()} == {(1, 7), (2, 7), (3, 8)}
    # passages in blocks of their own give the same rows
    whole, cut = (sorted(map(tuple, LeakageSearch(p, block=b).search(df).collect())) for b in (500_000, 1))
    assert whole == cut and len(whole) > 5


def test_planted_questions_are_found(spark):
    """Recall of items planted with other numbers, names and units in corpus texts, and no row for texts that merely share words."""
    rng = random.Random(11)
    vocabulary = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    items, docs, planted = [], [], set()
    for i in range(30):
        words = rng.choices(vocabulary, k=40)
        for at in range(3, 40, 8):
            words[at] = rng.choice(["17", "Brelm", "kg", "204", "Quost"])
        items.append((i, " ".join(words)))
    for d in range(300):
        filler = " ".join(rng.choices(vocabulary, k=80))
        if d % 3 == 0:
            i = rng.randrange(30)
            swap = {"17": str(rng.randint(20, 99)), "204": str(rng.randint(300, 999)), "Brelm": "Zand", "Quost": "Flim", "kg": "km"}
            filler += ". " + " ".join(swap.get(w, w) for w in items[i][1].split()) + ". " + " ".join(rng.choices(vocabulary, k=40))
            planted.add((d, i))
        docs.append((d, filler))
    got = {(r.doc, r.item) for r in LeakageSearch(spark.createDataFrame(items, "item_id long, text string")).templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == planted
    # thirteen numbers are met word for word only
    numbers = " ".join(str(n) for n in range(13))
    p = spark.createDataFrame([(1, numbers)], "item_id long, text string")
    rows = {r.doc: r for r in LeakageSearch(p).search(spark.createDataFrame([(1, numbers), (2, " ".join(str(n) for n in range(5, 40)))], "doc_id long, text string")).collect()}
    assert set(rows) == {1} and rows[1].verbatim == 1
