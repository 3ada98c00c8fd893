import numpy as np

from tapeline.llm import decontam

ITEM = "Alice has 12 apples and gives 5 kg of them to Bob. How many apples does Alice have left when the day ends?"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.leaks(d, b).collect()}


def test_canonical_templates():
    tokens, slots = decontam.canonical("Alice has 1,200 kg. The train to New York leaves at 12.")
    assert tokens == ["\x01e", "has", "\x01n", "\x01u", "the", "train", "to", "\x01e", "leaves", "at", "\x01n"]
    assert slots == [(0, "alice"), (2, "1,200"), (3, "kg"), (7, "new york"), (10, "12")]
    assert decontam.canonical(None) == ([], []) and decontam.canonical("kg alone")[0] == ["kg", "alone"]


def test_changed_numbers_and_names_are_found_if_consistent(spark):
    other = ITEM.replace("Alice", "Carol").replace("12", "99").replace("5 kg", "7 pounds").replace("Bob", "Dave")
    crooked = "Carol has 12 apples and gives 5 kg of them to Bob. How many apples does Emma have left when the day ends?"
    got = found(spark, [(1, "Intro words. " + other + " More."), (2, "Nothing of the kind here, only other words of some length."), (3, ITEM.lower()), (4, None), (5, crooked)], [(10, ITEM)])
    assert (1, 10) in got and got[1, 10].agreement == 1.0 and got[1, 10].coverage > 0.7
    assert (2, 10) not in got and (4, 10) not in got
    assert (5, 10) not in got or got[5, 10].agreement < 1


def brute(docs, items):
    out = set()
    for d, text in docs:
        t, s = decontam.canonical(text)
        for i, item in items:
            u, v = decontam.canonical(item)
            n = min(8, len(u))
            if n < 4:
                if 0 < n and (t, [f for _, f in s]) == (u, [f for _, f in v]):
                    out.add((d, i))
                continue
            fill = lambda slots, at: tuple(f for p, f in slots if at <= p < at + n)
            theirs = {}
            for at in range(len(t) - n + 1):
                theirs.setdefault(tuple(t[at : at + n]), set()).add(fill(s, at))
            spots = [at for at in range(len(u) - n + 1) if tuple(u[at : at + n]) in theirs]
            if len(spots) < min(8, 0.5 * (len(u) - n + 1)):
                continue
            votes = {}
            for at in spots:
                for their in theirs[tuple(u[at : at + n])]:
                    for a, b in zip(fill(v, at), their):
                        votes.setdefault(a, {}).setdefault(b, 0)
                        votes[a][b] += 1
            back = {}
            for a, x in votes.items():
                for b, k in x.items():
                    back.setdefault(b, {})[a] = k
            total = sum(sum(x.values()) for x in votes.values())
            if not total or min(sum(max(x.values()) for x in side.values()) for side in (votes, back)) / total >= 0.8:
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda: str(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "Rho", "7", "kg", "12", "x."]))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(2, 30))))) for i in range(25)]
    docs = []
    for d in range(60):
        words = [word() for _ in range(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 3))):
            t = items[int(rng.integers(25))][1].split()
            a = int(rng.integers(0, len(t)))
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = t[a:] if rng.random() < 0.5 else [w if w not in ("7", "12") else "55" for w in t]
        docs.append((d, " ".join(words)))
    assert set(found(spark, docs, items)) == brute(docs, items)


def test_without_broadcast_the_result_is_the_same(spark, monkeypatch):
    docs, items = [(1, ITEM + " " + "tail " * 50), (2, "clean words only, none of the item's")], [(10, ITEM), (11, "one two three four five")]
    want = set(found(spark, docs, items))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, docs, items)) == want == {(1, 10)}


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (None, ITEM, 0), (2, "", 0), (3, "w " * 100_000, 0)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(10, ITEM), (None, ITEM), (11, ""), (12, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()] == [(1, 10)]
    assert sorted(str(r.doc_id) for r in decontam.clean(d, b).collect()) == ["2", "3", "None"]
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def variant(n, who="Carol", to="Dave"):
    return ITEM.replace("Alice", who).replace("Bob", to).replace("12", str(n)).replace("5 kg", f"{n + 1} pounds")


def test_one_consistent_occurrence_is_a_leak_whatever_else_has_its_template(spark):
    broken = ITEM.replace("How many apples", "How many red apples")
    sevens = "they count 7 red and 7 blue and 7 green and 7 white and 7 black and 7 grey beads in the box today"
    crooked = [" ".join(str(n + i) if w == "7" else w for i, w in enumerate(sevens.split())) for n in (30, 60)]
    docs = [
        (1, ITEM + " Now another one. " + variant(70)),
        (2, " Next. ".join(variant(n, who, to) for n, who, to in ((20, "Emma", "Noah"), (30, "Liam", "Kate"), (40, "Anna", "Paul")))),
        (3, variant(80) + " " + broken + " " + variant(90, "Liam", "Kate")),
        (4, " Next. ".join(crooked)),
        (5, crooked[0] + ". Next. " + sevens.replace("7", "8")),
    ]
    got = found(spark, docs, [(10, ITEM), (11, variant(70)), (12, sevens)])
    assert set(got) == {(d, i) for d in (1, 2, 3) for i in (10, 11)} | {(5, 12)}
    assert got[1, 10].agreement == got[1, 11].agreement == got[2, 10].agreement == 1.0


def test_two_fillings_that_become_one_do_not_agree(spark):
    item = "Alice has 3 apples and Bob has 5 pears, so Alice gives 3 and Bob gives 5 away."
    same = item.replace("Alice", "Carol").replace("Bob", "Carol").replace("3", "7").replace("5", "7")
    other = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "7").replace("5", "9")
    got = found(spark, [(1, same), (2, other)], [(10, item)])
    assert (1, 10) not in got and got[2, 10].agreement == 1.0


def test_short_items_are_found_as_whole_documents(spark):
    got = found(spark, [(1, "Two plus two"), (2, "what is two plus two or more"), (3, "7 plus 2"), (4, "7 plus 3"), (5, "two"), (6, None)], [(10, "two plus two"), (11, "7 plus 2"), (12, "Two."), (13, "")])
    assert set(got) == {(1, 10), (3, 11), (5, 12)}


def test_german_nouns_are_no_names():
    tokens, slots = decontam.canonical("Der Mann kauft der Frau 3 Brote und ein Glas Wasser. Wie viel zahlt Anna?")
    assert slots == [(5, "3"), (14, "anna")] and tokens[:3] == ["der", "mann", "kauft"]
    assert decontam.canonical("The man meets Smith at noon.")[1] == [(3, "smith")]
