import random
import re

from tidemark.llm.decontaminate import NUMBER_WORDS, UNITS, find_leaks

TOKEN = re.compile(r"\d(?:[.,]?\d)*|[^\W\d_]+")


def tokens(t):
    out = []
    for x in TOKEN.findall(t or ""):
        low = x.lower()
        kind = 1 if x[0].isdigit() or low in NUMBER_WORDS else 2 if low in UNITS else 3 if x[0].isupper() and not (len(x) > 1 and x[1].isupper()) else 0
        out.append((low, kind))
    return out


def brute(text, item, n=8, share=0.5, run=5):
    """All alignments, windows compared token by token."""
    a, b = tokens(item), tokens(text)
    n = min(n, len(a))
    best = None
    for s in range(-len(a), len(b) + 1):
        same = [0 <= i + s < len(b) for i in range(len(a))]
        tmpl = [same[i] and (a[i] == b[i + s] or (a[i][1] == b[i + s][1] > 0)) for i in range(len(a))]
        lit = [same[i] and a[i][0] == b[i + s][0] for i in range(len(a))]
        on = sorted({j for m in (tmpl, lit) for i in range(len(a) - n + 1) if n and all(m[i : i + n]) for j in range(i, i + n)})
        if not on or len(on) < min(len(a), max(run, share * len(a))):
            continue
        slots = [(a[i][0], b[i + s][0]) for i in on if a[i][1] and a[i][1] == b[i + s][1]]
        refilled = sum(x != y for x, y in slots)
        k = len(set(slots))
        literals = sum(a[i][1] == 0 for i in on)
        if (k != len({x for x, _ in slots}) or k != len({y for _, y in slots}) or 2 * literals < len(on)) and refilled > 0.2 * len(on):
            continue
        got = (len(on), len(slots), refilled, on[0] + s)
        best = max(best, got) if best else got
    return best


def test_against_brute_force(spark):
    r = random.Random(4)
    voc = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    names, units = ["Tom", "Anna", "Émile", "Bob"], ["km", "hours", "kg"]

    def say(n):
        return [r.choice(voc) if r.random() < 0.7 else r.choice([r.choice(names), str(r.randint(1, 99)), "1,5" + str(r.randint(0, 9)), r.choice(units), "seven"]) for _ in range(n)]

    items = [(i, " ".join(say(r.randint(3, 40)))) for i in range(12)] + [(12, None), (13, ""), (14, "Two trains, 5km apart"), (15, "two")]
    texts = [None, "", "  \n", "one two three", "a TWO b"]
    for _ in range(60):
        x = say(r.randint(0, 60))
        _, it = items[r.randrange(12)]
        w = it.split()
        if r.random() < 0.5:  # filled anew
            m = {a: r.choice(names) for a in names} if r.random() < 0.4 else dict(zip(names, r.sample(names, 4), strict=True))
            w = [m.get(y, str(int(y) + 3) if y.isdigit() else y) for y in w]
        if r.random() < 0.4:
            w[r.randrange(len(w))] = "other"
        if r.random() < 0.3:
            w = w[: r.randint(1, len(w))]
        i = r.randint(0, len(x))
        texts.append(" ".join(x[:i] + w + x[i:]) + r.choice([".", "\n", ""]))
    texts += ["two trains, 9km apart!", "(Two trains; 5 km apart)", " ".join(say(20000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, leaks int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 400):
        got = {x.row.doc_id: {k.item_id: (k.tokens, k.slots, k.refilled, k.start) for k in x.leaks} for x in find_leaks(df, bench, part_bytes=size).collect()}
        for i, t in enumerate(texts):
            want = {j: f for j, it in items if it and (f := brute(t, it))}
            assert got[i] == want, (i, t)
    assert sum(bool(v) for v in got.values()) > 25


def test_slots_must_be_consistent(spark):
    item = "Anna gave Tom 5 apples and then Tom gave Anna 3 pears while Anna kept 5 plums"
    good = "Eve gave Max 8 apples and then Max gave Eve 2 pears while Eve kept 8 plums"
    bad = "Eve gave Max 8 apples and then Ida gave Ben 2 pears while Ugo kept 7 plums"
    df = spark.createDataFrame([(1, "So: " + good), (2, bad), (3, item.lower()), (4, item)], "doc_id long, text string")
    got = {x.row.doc_id: len(x.leaks) for x in find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [len(x.leaks) for x in find_leaks(df, none).collect()] == [0]
    assert find_leaks(df.limit(0), none).collect() == []


def test_runs_are_joined_over_shifts(spark):
    r = random.Random(11)
    say = lambda n, k: [f"{k}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(n)]
    long, huge = say(40, "w"), say(400, "v")
    names = "Anna gave Tom 5 apples and then Tom gave Anna 3 pears while Anna kept 5 plums"
    more = names.replace("Anna", "Anna Maria")
    texts = [
        (1, " ".join([*long[:13], "xx", *long[13:26], "yy", *long[26:]]), [1]),
        (2, " ".join([*long[26:], *say(9, "z"), *long[13:26], *say(9, "z"), *long[:13]]), []),  # out of order
        (3, "So: " + more, [2]),
        (4, more.replace("Tom", "Bob Lee").replace("5", "twenty five"), [2]),
        (5, "Anna Maria gave Tom 5 apples and then Ida gave Eva Lee 3 pears while Ugo Max kept 7 plums", []),  # names at will
        (6, " ".join(say(30, "z") + huge[100:160] + say(30, "z")), [3]),
        (7, " ".join(say(30, "z") + huge[100:140] + say(30, "z")), []),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, names), (3, " ".join(huge))], "item_id long, text string")
    got = {x.row.doc_id: [k.item_id for k in x.leaks] for x in find_leaks(df, bench).collect()}
    assert got == {i: want for i, _, want in texts}
