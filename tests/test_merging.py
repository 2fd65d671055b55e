import random

from tarn.operators import merging


def jac(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def by_hand(texts):
    if len(texts) == 1:
        return texts[0]
    parts = [[p.strip() for p in t.split("\n\n") if p.strip()] for t in texts]
    line = [p for own in parts for p in own]
    leader = {}
    for i, p in enumerate(line):
        leader[i] = next((j for j in range(i) if leader[j] == j and jac(line[j], p) > 0.7), i)
    classes = []
    for j in (j for j in leader if leader[j] == j):
        classes.append(max((line[i] for i in leader if leader[i] == j), key=len))
    lead = {}
    for k, p in enumerate(parts[0]):
        first = next((c for c, text in enumerate(classes) if jac(text, p) > 0.6), None)
        if first is not None:
            lead.setdefault(first, k)
    order = sorted(range(len(classes)), key=lambda c: (c not in lead, lead.get(c, 0), c))
    return "\n\n".join(classes[c] for c in order)


def test_against_sequential_merging(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows, want = [(900, 0, "Only  text\n\n\nstays.\n"), (901, 0, None), (902, 0, ""), (902, 1, "\n\n")], {900: "Only  text\n\n\nstays.\n", 902: ""}
    for group in range(60):
        base = [rnd.choices(words, k=rnd.randrange(1, 15)) for _ in range(5)]
        texts = []
        for _ in range(rnd.randrange(2, 5)):
            some = [list(rnd.choice(base)) for _ in range(rnd.randrange(1, 5))]
            for p in some:
                for _ in range(rnd.randrange(3)):
                    p[rnd.randrange(len(p))] = rnd.choice(words)
                p += [rnd.choice(words)] * rnd.randrange(2)
            texts.append("\n\n".join(" ".join(p) + "." * (i + len(texts)) for i, p in enumerate(some)))
        rows += [(group, i, t) for i, t in enumerate(texts)]
        want[group] = by_hand(texts)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "group long, place int, text string").repartition(4)
    got = {r["group"]: r["text"] for r in merging.merged_texts(df).collect()}
    assert {g: t for g, t in got.items() if t != want[g]} == {} and got.keys() == want.keys()
    assert merging.merged_texts(df.limit(0)).count() == 0
