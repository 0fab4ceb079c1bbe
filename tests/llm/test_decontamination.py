import random
import re

import pytest

from burrow.llm import decontamination as D
from tests.llm.odd import no_documents, odd_documents

ITEMS = [
    (1, "A train leaves Boston at 9 in the morning and travels 120 miles to the north, so how many hours does it need at 40 miles an hour?"),
    (2, "The old clockmaker kept seven brass keys beside the narrow window that looked over the quiet harbour of the town."),
    (3, "Short words here."),
    (4, None), (5, ""), (6, "? ! ..."),
]


def report(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, D.contamination_report(docs, bench).select("doc_id", "item_id", "n_changed").collect()))


def test_copies_and_new_parameters_are_caught(spark):
    item = ITEMS[0][1]
    texts = [
        f"Some words before. {item} And some after.",
        "Noise noise " + re.sub(r"\s", "\n", item.upper().lower()),
        "We ask: " + item.replace("Boston", "Denver").replace("9", "11").replace("120", "350").replace("40", "70"),
        "We ask: " + item.replace("40 miles", "60 kilometres").replace("120 miles", "60 km"),
        "A train may leave at any time and travel to the north if it wants to, they said to us at noon.",
        ITEMS[1][1].replace("seven", "twelve").replace(" beside", ", beside"),
        " ".join(ITEMS[1][1].split()[:9]),
        None, "", "?",
        "The words say: Short words here. Yes.",
    ]
    assert report(spark, texts) == [(0, 1, 0), (1, 1, 0), (2, 1, 4), (3, 1, 3), (5, 2, 1), (10, 3, 0)]


def test_slots_must_be_consistent(spark):
    item = [(1, "take 5 apples from the basket then put 5 pears back in and after that count 5 plums on the table by the door")]
    same = "take 8 apples from the basket then put 8 pears back in and after that count 8 plums on the table by the door"
    other = same.replace("8 pears", "3 pears")
    assert report(spark, [same, other], item) == [(0, 1, 3)]


def test_each_alignment_is_judged_by_itself(spark):
    """An item whose sentences are alike meets itself, and a text may hold it twice or in parts."""
    one = "A train travels at 60 km per hour for 2 hours and then stops at the old station by the river"
    two = "a train travels at 90 km per hour for 3 hours and then stops at the old station by the river"
    item = f"{one}, while {two}."
    other = item.replace("60", "70").replace("90", "80").replace("2", "5").replace("3", "6")
    texts = [
        f"We say: {item} So it goes.",
        f"We say: {other} So it goes.",
        f"{item} And again: {other} And {item.replace('60', '75')}",
        f"{one}, as everybody in the whole town would know by now, while {two}.",
        f"{two}. It was said in between that {one}, while",
    ]
    got = report(spark, texts, [(1, item)])
    assert [r for r in got if r[0] in (0, 2)] == [(0, 1, 0), (2, 1, 0)] and (1, 1, 4) in got and {r[0] for r in got} == {0, 1, 2, 3, 4}


def test_marks_beside_a_value_dont_count(spark):
    item = [(1, "take 5 apples from the basket then put 5 pears back in and after that count 5, maybe more plums on the table by the door")]
    texts = [item[0][1].replace("5 pears", "5, pears"), item[0][1].replace("5,", "8").replace("5", "8")]
    assert report(spark, texts, item) == [(0, 1, 0), (1, 1, 3)]


def test_letters_of_all_scripts_are_folded(spark):
    items = [
        (1, "där står ännu på ön en gård där älven är öppen året om så är även våren åter här"),
        (2, "große straßen führen über die flüsse außerhalb der stadt während draußen alles weiß ist"),
        (3, "ο δρόμος της πόλης είναι μακρύς και ο ήλιος καίει τους τοίχους όλης της παλιάς αγοράς"),
    ]
    texts = [f"xx yy {t.upper()} zz" for _, t in items] + [t.title() for _, t in items] + [t for _, t in items]
    assert report(spark, texts, items) == [(k, k % 3 + 1, 0) for k in range(9)]
    assert report(spark, [t for _, t in items], [(k, t.upper()) for k, t in items]) == [(k, k + 1, 0) for k in range(3)]


@pytest.mark.parametrize("small", [D.SMALL, 0])
def test_short_items_are_met_at_every_offset(spark, monkeypatch, small):
    """Items of few windows, or with few that have enough literal words."""
    monkeypatch.setattr(D, "SMALL", small)
    said = "where does the tall keeper hide his little golden lamps".split()
    items = [(n, " ".join(said[:n])) for n in (8, 9, 10)] + [(20, "7 7 7 7 7 7 7 7 which of them was not 7 7 7 7 7 7 7 7")]
    texts = [" ".join([*[f"w{chr(97 + j)}" for j in range(at)], item, "and more words than that"]) for _, item in items for at in range(8)]
    got = {r[:2] for r in report(spark, texts, items)}
    assert {(8 * j + at, items[j][0]) for j in range(4) for at in range(8)} <= got


def canon(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(D.canonical(D.raw_words(D.F.col("t")))).first()[0].replace("\u0001", "@")


def test_names_are_typed(spark):
    said = {
        "Janet has 3 cats. How many?": "@m has @n cats how many",
        "we saw John Smith, and Maria's dog in New York City today": "we saw @m @m and @m dog in @m @m @m today",
        "Then Tom Lee left. Anna stayed! \"Bob ran.\"": "then tom lee left @m stayed bob ran",
        "The Old Man And The Sea was read": "the old man and the sea was read",
        "a b Alpha Bravo Carol Delta e": "a b alpha bravo carol delta e",
        "In Paris it rains": "in paris it rains",
        "JANET HAS 3": "janet has @n",
    }
    assert {t: canon(spark, t) for t in said} == said


def test_new_names_at_the_start_are_caught(spark):
    item = [(1, "Janet Miller has 16 eggs a day. Janet Miller eats 3 of them for breakfast and sells the rest at the market, so how much does Janet Miller make?")]
    other = item[0][1].replace("Janet Miller", "Robert Jones").replace("16", "20").replace("3 ", "5 ")
    mixed_up = "Robert Jones has 16 eggs a day. Peter Brown eats 3 of them"
    assert report(spark, [f"Once more: {other}", mixed_up], item) == [(0, 1, 8)]


def plain(text):
    """Canonical words and raw words, for texts of lower-case words and numbers."""
    raw = text.split()
    return ["@" if w.isdigit() else w for w in raw], raw


def best_run(text, item):
    """Brute force over all single alignments: the best coverage with consistent slots."""
    (tc, tr), (ic, ir) = plain(text), plain(item)
    best = 0.0
    for d in range(-len(ic) + 1, len(tc)):
        same = [i for i in range(len(ic)) if 0 <= i + d < len(tc) and tc[i + d] == ic[i]]
        run = lambda i: all(i + j in same for j in range(D.WINDOW)) and sum(ic[i + j] != "@" for j in range(D.WINDOW)) >= D.LITERALS
        if not any(run(i) for i in range(len(ic) - D.WINDOW + 1)):
            continue
        slots = {(ir[i], tr[i + d]) for i in same if ic[i] == "@"}
        if len({a for a, _ in slots}) == len(slots):
            best = max(best, len(same) / len(ic))
    return best


def test_coverage_and_slots_equal_brute_force(spark):
    """Items cut short, with new numbers, some of them inconsistent, at random places."""
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    items = [(k, " ".join(str(rng.randrange(4)) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(12, 40)))) for k in range(12)]
    texts, want = [], []
    for k in range(150):
        item_id, item = rng.choice(items)
        words = item.split()
        if k % 3:
            new = {str(n): str(10 + n) for n in range(4)}
            words = [new.get(w, w) for w in words]
        if k % 5 == 0:
            at = [i for i, w in enumerate(words) if w.isdigit()]
            if at:
                words[rng.choice(at)] = "99"
        words = words[: rng.randrange(len(words) // 3, len(words) + 1)]
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randrange(20)), *words, *rng.choices(vocabulary, k=rng.randrange(20))]))
    for d, t in enumerate(texts):
        want += [(d, k) for k, item in items if best_run(t, item) >= D.COVERAGE]
    got = [r[:2] for r in report(spark, texts, items)]
    assert set(want) <= set(got) and 40 < len(want) < 120
    # A chain may change the alignment to leave out a position whose slot is inconsistent: what more is found differs in slots only.
    for d, k in set(got) - set(want):
        (tc, _), (ic, _) = plain(texts[d]), plain(dict(items)[k])
        assert max(sum(0 <= i + s < len(tc) and tc[i + s] == ic[i] for i in range(len(ic))) for s in range(-len(ic), len(tc))) / len(ic) >= D.COVERAGE


def slow(texts, items):
    """Brute force: the share of an item's words that stand in a text in one run, for texts that hold the whole item or none."""
    words = lambda t: [w for w in re.sub(r"[^a-z ]", "", re.sub(r"\s", " ", (t or "").lower())).split(" ") if w]
    out = []
    for d, t in enumerate(texts):
        for k, item in items:
            w, i = words(t), words(item)
            if i and any(w[p : p + len(i)] == i for p in range(len(w) - len(i) + 1)):
                out.append((d, k))
    return sorted(out)


def test_planted_items_equal_brute_force(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(["alpha", "bravo", "carol", "delta", "echos", "foxes", "golfs", "hotel", "india", "julia"]) + chr(97 + rng.randrange(26)) for _ in range(n))
    items = [(k, said(rng.randrange(15, 50))) for k in range(25)]
    texts = []
    for k in range(120):
        parts = [said(rng.randrange(0, 200))]
        if k % 3 == 0:
            parts.append(rng.choice(items)[1])
        if k % 10 == 0:
            parts.append(rng.choice(items)[1].title())
        texts.append("\n".join([*parts, said(rng.randrange(0, 60))]))
    got = [r[:2] for r in report(spark, texts, items)]
    assert got == slow(texts, items) and len(got) > 45


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    texts = [f"x y z {t} and more" for _, t in ITEMS if t] * 2
    want = report(spark, texts)
    monkeypatch.setattr(D, "SMALL", 0)
    assert report(spark, texts) == want and want


@pytest.mark.parametrize("items", [[], [(4, None), (5, "")]])
def test_without_items_nothing_goes(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = odd_documents(spark)
    assert D.drop_contaminated(odd, bench).count() == odd.count()


def test_odd_documents_and_columns(spark):
    bench = spark.createDataFrame([(1, "A text without an id. It has words.")], "item_id long, text string")
    odd = odd_documents(spark)
    left = D.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 1 and left.where("doc_id is null").count() == 0
    assert D.drop_contaminated(no_documents(spark), bench).count() == 0


def test_no_python_runs(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(1)
    plan = D.drop_contaminated(odd_documents(spark), bench)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
