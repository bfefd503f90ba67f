import re
from collections import Counter

from meridion.llm.decontaminate import COVERED, LONG, MIN_FILLED, UNITS, WINDOW, contamination, drop_contaminated, matches

from .fixtures import SCHEMA, documents, prose, words_of

ITEM = "if Alice has 12 apples and Bob has 7 apples how many apples do Alice and Bob have together after 3 days"


def frames(spark, extra=()):
    docs = spark.createDataFrame([*documents(), *extra], SCHEMA)
    items = spark.createDataFrame([(1, ITEM), (2, prose(500, 40)), (3, None), (4, "short item"), (5, prose(501, 30)), (5, prose(501, 30))], "item_id long, text string")
    return docs, items


def test_reparameterised_questions(spark):
    extra = [
        (901, "so " + ITEM.replace("Alice", "Maria").replace("Bob", "Peter").replace("12", "45").replace("7", "9") + " ok", "en", "s", 1),
        (902, "so " + ITEM.replace("do Alice and Bob", "do Bob and Alice").replace("12", "45") + " ok", "en", "s", 1),
        (903, prose(600, 50) + " " + prose(500, 40) + " " + prose(601, 50), "en", "s", 1),
        (904, prose(500, 40).upper(), "en", "s", 1),
        (905, " ".join(prose(500, 40).split()[:9]), "en", "s", 1),
    ]
    docs, items = frames(spark, extra)
    got = {(r.doc_id, r.item_id): r for r in contamination(docs, items).collect()}
    assert got[901, 1].contaminated and got[901, 1].coverage == 1
    assert got[902, 1].coverage < 1  # the names change places, so slots clash along the way
    assert got[903, 2].contaminated and got[904, 2].contaminated
    assert not got[905, 2].contaminated
    assert {d for d, _ in got} == {901, 902, 903, 904, 905}


def test_both_joins_agree(spark):
    docs, items = frames(spark, [(903, prose(600, 50) + " " + prose(500, 40), "en", "s", 1), (901, ITEM, "en", "s", 1)])
    a, b = (sorted(tuple(r) for r in matches(docs, items, size).collect()) for size in (0, 1 << 30))
    assert a == b and a


def test_stage(spark):
    docs, items = frames(spark, [(901, ITEM, "en", "s", 1)])
    docs = docs.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "contaminated")
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count() - 1
    assert drop_contaminated(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()
    for size in (0, 1 << 30):
        kept = drop_contaminated(docs, items, size).collect()
        assert sorted(map(str, kept)) == sorted(map(str, out.collect()))


def symbols(text):
    """(symbol or None for a placeholder's type, value) of each word, by plain rules for ASCII texts and those with lower-case marks."""
    words, out = words_of(text), []
    lines = [k for k, w in enumerate(words)]
    firsts, at = set(), 0
    for line in (text or "").split("\n"):
        n = len(words_of(line))
        if n:
            firsts.add(at)
        at += n
    cores = []
    for w in words:
        trimmed = re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", w) or w[0]
        cores.append(trimmed)
    number = [any(c in "0123456789" for c in x) for x in cores]
    for k, x in enumerate(cores):
        first = k in firsts or (k and words[k - 1][-1] in ".!?:")
        name = x[0].lower() != x[0] and len(x) > 1 and x[1].lower() == x[1] and not first and not number[k]
        kind = "9" if number[k] else "unit" if k and number[k - 1] and x.lower() in UNITS else "name" if name else None
        out.append((kind, x.lower()))
    return out


def brute(docs, items):
    """(doc_id, item_id) of contaminated pairs, by comparing all windows."""
    out = set()
    texts = {}
    for i, t in items:
        if t is not None:
            texts[t] = min(i, texts.get(t, i))
    for d, t, *_ in docs:
        own = symbols(t)
        if d is None:
            continue
        for text, i in texts.items():
            item = symbols(text)
            width = min(WINDOW, len(item))
            if width >= MIN_FILLED:
                plain = [tuple(v for _, v in item[k : k + width]) for k in range(len(item) - width + 1)]
                here = {tuple(v for _, v in own[k : k + width]) for k in range(len(own) - width + 1)}
                if sum(p in here for p in plain) >= min(LONG, COVERED * len(plain)):
                    out.add((d, i))
            starts = [k for k in range(len(item) - WINDOW + 1) if sum(x[0] is None for x in item[k : k + WINDOW]) >= MIN_FILLED]
            bound, good = {}, set()
            for k in starts:
                for j in range(len(own) - WINDOW + 1):
                    a, b = item[k : k + WINDOW], own[j : j + WINDOW]
                    if [x[0] or x[1] for x in a] != [x[0] or x[1] for x in b]:
                        continue
                    there, back = bound.get(j - k, ({}, {}))
                    there, back = dict(there), dict(back)
                    if all(there.setdefault(x[1], y[1]) == y[1] and back.setdefault(y[1], x[1]) == x[1] for x, y in zip(a, b) if x[0]):
                        bound[j - k] = there, back
                        good.add(k)
            if starts and len(good) >= min(LONG, COVERED * len(starts)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    titled = "The Great River Runs Through Five Old Towns Before Noon"
    numbers = "12 7 99 3 1000 41 6 8 23"
    items = [(1, ITEM), (2, prose(500, 40)), (3, None), (4, "too short"), (5, prose(501, 30)), (6, prose(501, 30)), (7, titled), (8, numbers), (9, "name five towns along the river"), (10, ITEM.replace("12", "13"))]
    docs = [r for r in documents() if len(r[1] or "") < 4000]
    docs += [(900 + k, t, "en", "s", 1) for k, t in enumerate([
        "so " + ITEM.replace("Alice", "Maria").replace("Bob", "Peter").replace("12", "45") + " ok", ITEM.replace("Bob", "Alice"), ITEM.upper(), titled.lower(), "so " + titled + " it is", "x " + numbers, "12 7 99 3 1000 41 6 8 24",
        "please name five towns along the river now", "name five towns along the sea", prose(1, 20) + " " + prose(501, 30) + " " + prose(2, 20), "((((((((((((" + ITEM.replace(" ", " ,,,,,,,,,,,,,") + "))))))))))))", None, "",
    ])]
    docs += [(900, "an unlike text under a number that is used", "en", "s", 1), (900, ITEM, "en", "s", 1)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    truth = brute(docs, items)
    assert {(900, 1), (902, 1), (903, 7), (904, 7), (905, 8), (907, 9), (909, 5), (910, 1)} <= truth and (908, 9) not in truth
    assert {(r.doc_id, r.item_id) for r in contamination(df, bench).where("contaminated").collect()} == truth
    assert {(r.doc_id, r.item_id) for r in contamination(df, bench, enough=True).collect()} == truth


def test_rows_that_share_a_doc_id(spark):
    """Windows of different rows never add up, whichever join is taken."""
    words = prose(700, 60).lower().split()
    rows = [(7, " ".join(words[:11]), "en", "s", 1), (7, " ".join(words[11:22]), "en", "s", 1), (8, " ".join(words), "en", "s", 1)]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for enough in (False, True):
        a, b = (Counter(tuple(r) for r in matches(docs, items, size, enough).collect()) for size in (0, 1 << 30))
        assert a == b and (enough or sum(a.values()) > 2) and all(n < LONG for d, _, n, _ in a if d == 7)
    for size in (0, 1 << 30):
        assert [r.doc_id for r in drop_contaminated(docs, items, size).collect()] == [7, 7]
