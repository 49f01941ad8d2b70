"""The language-model operators against plain versions and on edge cases."""

import base64
import math
import pathlib
import random
from collections import Counter
from functools import cache
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import bpe, packing, percentiles, textstats

# tokens


@pytest.fixture(scope="module")
def exact():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.DEFAULT_PATH.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n", "\n\nx", "a\nb", "a \n b", "a\n\n\nb\n", "\x85a\x1cb\n\x1cc", "it's we'll 's", "<|endoftext|>", "The 1234567 volumes.", "日本語のテキスト。\n二行目", "🐟👨‍👩‍👧", "x" * 3000, "ab" * 2000, "﻿text", "нет, это не так"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(exact, text):
    assert bpe.encoder(bpe.DEFAULT_PATH).encode(text) == exact.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\r\t.,'abcdeinorst0123é日​"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_of_any_text(exact, text):
    assert bpe.encoder(bpe.DEFAULT_PATH).encode(text) == exact.encode_ordinary(text)


def test_encode_documents(spark, exact):
    rows = [(i, t, "clash", [9]) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (101, "word " * 300_000, None, None), (102, TEXTS[10], None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, ids array<int>")
    got = {r.id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: exact.encode_ordinary(t or "") for i, t, *_ in rows}
    assert {r.id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


# containers


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=20))
def test_plan_holds_everything(counts):
    patterns = packing.plan(counts, 50)
    held = Counter()
    for p in patterns:
        assert p.times > 0 and sum(s * n for s, n in p.items.items()) <= 50
        for s, n in p.items.items():
            held[s] += n * p.times
    assert held == Counter(counts)
    assert [p.first for p in patterns] == list(np.cumsum([0, *(p.times for p in patterns)]))[:-1]


def test_plan_is_that_of_single_containers():
    """Containers made at once are those that one at a time would give."""

    def greedy(sizes, capacity):
        sizes, out = sorted(sizes), []
        while sizes:
            own, gap = [], capacity
            while fit := [s for s in sizes if s <= gap]:
                own.append(fit[-1])
                sizes.remove(fit[-1])
                gap -= fit[-1]
            while gap:
                small = min(own)
                pairs = [(sizes[i] + sizes[j], sizes[i], sizes[j]) for i in range(len(sizes)) for j in range(i) if small < sizes[i] + sizes[j] <= gap + small]
                if not pairs:
                    break
                _, a, b = max(pairs)
                own.remove(small)
                sizes.remove(a)
                sizes.remove(b)
                sizes = sorted([*sizes, small])
                own += [a, b]
                gap += small - a - b
            out.append(sum(own))
        return sorted(out)

    rnd = random.Random(1)
    for _ in range(20):
        counts = Counter(rnd.choice([3, 5, 7, 8, 11, 14, 17]) for _ in range(40))
        mine = sorted(sum(s * n for s, n in p.items.items()) for p in packing.plan(dict(counts), 20) for _ in range(p.times))
        assert mine == greedy(list(counts.elements()), 20)


def _least_containers(items, capacity):
    """Martello and Toth's bound L2: no packing does with fewer containers, since of items above half of the capacity no two fit together."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = sum(n for s, n in items.items() if s > capacity - k)
        half = [(s, n) for s, n in items.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in items.items() if k <= s <= capacity // 2)
        count = sum(n for _, n in half)
        best = max(best, big + count + max(0, math.ceil((small - (count * capacity - sum(s * n for s, n in half))) / capacity)))
    return best


@pytest.mark.parametrize("salts", [1, 7])
def test_pack(spark, salts):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 1, 5, 30, 64, 65, 100, 640, None, rnd.randint(1, 64)]), "clash") for i in range(600)]
    df = spark.createDataFrame(sizes, "id bigint, n_tokens bigint, size string")
    rows = packing.pack(df, 64, salts).collect()
    load, pieces = Counter(), {}
    for r in rows:
        load[r.container_id] += r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(load.values()) <= 64
    for i, n, _ in sizes:
        own = sorted(pieces[i])
        assert sum(x for _, x in own) == (n or 0) and [a for a, _ in own] == [64 * k for k in range(len(own))]
        assert len(own) == max(1, math.ceil((n or 0) / 64))
    items = Counter(r.n_tokens for r in rows if r.n_tokens)
    assert len(load) <= _least_containers(items, 64) * 1.02 + 1
    assert packing.pack(df.limit(0), 64, salts).count() == 0
    assert {r.container_id for r in packing.pack(df.filter("n_tokens = 0"), 64, salts).collect()} == {0}


# percentiles

VALUES = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1023.9999999999999, 1024.0, 2**-1022 * 1.5, -3.75, 8.0, 0.1 + 0.2]


def test_ordered_keys(spark):
    rnd = random.Random(4)
    values = VALUES + [rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(3000)] + [2.0**k for k in range(-1070, 1023)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1023)]
    df = percentiles.with_key(spark.createDataFrame([(v,) for v in values], "x double"), F.col("x"))
    rows = df.select("x", "key", percentiles.value_of(F.col("key")).alias("back")).collect()
    assert all(r.x == r.back for r in rows)
    rows.sort(key=lambda r: r.x)
    assert all((a.key < b.key) == (a.x < b.x) and (a.key == b.key) == (a.x == b.x) for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("salts", [1, 5])
@pytest.mark.parametrize("widths", [(16, 16, 16, 16), (12, 20, 32)])
def test_radix_select(spark, salts, widths):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.lognormvariate(3, 2), 7.0, -rnd.random(), None, float("nan")]), 1) for _ in range(3000)] + [("one", 3.5, 1), ("none", None, 1), ("close", 1.0, 1), ("close", math.nextafter(1.0, 2), 1)]
    df = spark.createDataFrame(rows, "g string, x double, digit int").filter(percentiles.usable(F.col("x")))
    df = percentiles.with_key(df, F.col("x")).select("g", "key")
    permilles = (1, 500, 900, 1000)
    got = {(r.g, r.permille): (r.n, r.value) for r in percentiles.radix_select(df, {"g": ["g"]}, permilles, widths, salts).select("g", "n", "permille", percentiles.value_of(F.col("key")).alias("value")).collect()}
    want = {}
    for g in ("a", "b", None, "one", "close"):
        own = sorted(x for h, x, _ in rows if h == g and x is not None and not math.isnan(x))
        for p in permilles:
            want[g, p] = (len(own), own[max(math.ceil(p * len(own) / 1000), 1) - 1])
    assert got == want
    assert percentiles.radix_select(df.limit(0), {"g": ["g"]}, permilles).count() == 0


def test_salted_digits_are_not_broadcast(spark):
    """Spark's sizes leave out the salts, so a list below its threshold has 64 times as many rows as it takes it for, and they would all come to the driver."""
    df = percentiles.with_key(spark.range(4000).selectExpr("id % 10 as g", "1 + id / 1e6 as x"), F.col("x")).drop("x")
    found = percentiles.radix_select(df, {"g": ["g"]}, (500, 900, 990))
    assert found.count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x]


@pytest.mark.parametrize("bits", [16, 24])
def test_summaries_combine(spark, bits):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), day, rnd.choice([1, -1]) * rnd.lognormvariate(2, 3)) for day in range(5) for _ in range(300)]
    df = percentiles.with_key(spark.createDataFrame(rows, "g string, day int, x double"), F.col("x"))
    parts = percentiles.summary(df.filter("day < 2"), ["g", "day"], bits).unionByName(percentiles.summary(df.filter("day >= 2"), ["g", "day"], bits))
    whole = percentiles.percentiles_of(percentiles.combine(parts, ["g"]), ["g"], (250, 500, 990), bits).collect()
    assert len(whole) == 6
    for r in whole:
        own = sorted(x for g, _, x in rows if g == r.g)
        true = own[math.ceil(r.permille * len(own) / 1000) - 1]
        assert r.n == len(own) and abs(r.value - true) <= abs(true) * 2.0 ** (12 - bits)


# text statistics

DOCUMENTS = pathlib.Path("/root/testdata/sf0.01/documents.parquet")

PROSE = "The old harbour was rebuilt after a long dispute, and most of the lower town had to be closed. It was not until 1904 that the road was opened."


@pytest.mark.parametrize(
    "kind,text",
    [
        (None, PROSE),
        (None, "== History ==\n\n" + PROSE + "\n\n[[Category:Towns]]\n{{stub}}"),
        (None, "The old harbour was rebuilt after a long dispute, and most of the\nlower town had to be closed. It was not until 1904 that the road\nwas opened.<ref>A. Name, 1904, p. 12</ref>"),
        ("list", "* [[Oakton]]\n* Elmford (1904)\n* The stone bridge\n* Ashby, 1888"),
        ("list", "Oakton\nElmford (1904)\nThe stone bridge\n[[Ashby]]\n1) Birchley\n2) Pinemoor"),
        ("list", ";Oakton\n:Elmford\n;Ashby\n:Birchley"),
        ("list", "Oakton • Elmford • The stone bridge • Ashby"),
        ("table", "Name;Boats;Pupils\nOakton;12;\nElmford;33.8;79%\nAshby;;5"),
        ("table", "{|\n|-\n! Name !! Boats\n|-\n| Oakton\n| 12\n|-\n| Elmford\n| 7%\n|}"),
        ("table", "Name            Boats          Pupils\nOakton          12             40%\nElmford         –              7"),
        ("junk", "{{Infobox river\n| name0 = {{PAGENAME}}\n| code1 = \n}}\n\n{{Coord|name={{{name|}}}|width=auto}}"),
        ("junk", "Tqn 410 fnuub xo Hxurufrlt majrwnm jw dworwrbqnm ljwju cqn njauh byarwp."),
        ("junk", ".denepo saw daor eht taht 4091 litnu ton saw tI .desolc eb ot dah nwot rewol eht fo tsom dna ,etupsid gnol a retfa"),
        ("junk", "lol lol lol lol lol lol lol lol lol lol lol lol"),
        ("junk", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
        ("junk", "ERROR line 91: nil value (field '8')\nlocal p59 = frame.args[51]\n  end -- 142/97"),
        (None, "古い港は石の橋を買い取ったが、町議会は開いたままだった。1943年に博物館が地図の集まりを設立した。"),
        (None, "Хотя стекольный завод остался открытым, старый порт потерял два колокола. В Тероец насчитывается 288 учеников."),
        *((None, x) for x in ("", None, "   \n ", "#REDIRECT [[Oakton]]", "#перенаправление [[Oakton]]\n{{R from move}}", "== History ==", "﻿")),
    ],
)
@pytest.mark.parametrize("fitted", [False, True])
def test_kinds(kind, text, fitted):
    assert textstats.describe([text], corpus() if fitted else textstats.at_start())["doc_kind"] == [kind]


@cache
def corpus():
    """A model of the test documents, or of a few texts if there are none."""
    if DOCUMENTS.exists():
        return textstats.fit(pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist())
    return textstats.fit([PROSE] * 20)


OTHERS = {
    "Polish": (None, "W zeszłym roku mieszkańcy małego miasteczka nad rzeką postanowili odnowić stary ratusz, który od dawna stał pusty i niszczał.\nPrace rozpoczęły się wiosną i potrwają do końca przyszłego roku."),
    "Finnish": (None, "Hallituksen mukaan uusi laki parantaa pienten yritysten mahdollisuuksia palkata lisää työntekijöitä syrjäseuduilla."),
    "Hungarian": (None, "A kormány tegnap elfogadta az új törvényt, amely jelentősen megváltoztatja az iskolák működését vidéken."),
    "Ukrainian": (None, "Уряд ухвалив новий закон, який змінить порядок виплати пенсій мешканцям сільської місцевості."),
    "Greek": (None, "Η κυβέρνηση ανακοίνωσε χθες νέα μέτρα για την ενίσχυση των μικρών επιχειρήσεων στην επαρχία."),
    "few common words": (None, "Spark executors spill sorted runs to local disk whenever available memory cannot hold every record of one partition.\nShuffle readers merge those runs lazily, keeping peak memory bounded."),
    "cookie banner": (None, "We use cookies to improve your experience on this site. By continuing you agree to our policy.\nAccept all\nReject all\nSettings"),
    "commas": ("table", "id,name,price,stock\n1,Widget,9.99,12\n2,Gadget,14.50,7\n3,Gizmo,3.25,140\n4,Doohickey,8.00,0"),
    "JSON lines": ("junk", '{"id": 1, "name": "Widget", "price": 9.99}\n{"id": 2, "name": "Gadget", "price": 14.5}\n{"id": 3, "name": "Gizmo", "tags": ["a", "b"]}'),
    "code": ("junk", "def load(path):\n    with open(path) as f:\n        rows = [line.split(',') for line in f]\n    return rows\n\nfor r in load('x.csv'):\n    print(r[0], r[1])\nif __name__ == '__main__':\n    main()"),
    "vandalism": ("junk", "banana banana banana banana\nyo mama\nyo mama\nyo mama\nbanana banana banana\nBANANA!!!"),
    "keys": ("junk", "asdkjh qwlekj zxmcnb qpwoei\nlkjasd mnbzxc qweoiu asdjkl zmxncb pqowei\nsdfkjh xcvmnb weriou"),
    "tags": ("junk", '<div class="nav"><a href="/home">Home</a></div>\n<span>&nbsp;</span>\n<br/>\n<div id=x></div>'),
    "recipe": ("list", "2 eggs\n1 cup of sugar\n250 g flour\nA pinch of salt"),
    "semicolons": ("list", "The stone bridge; Oakton; Two of its bells; Elmford; Ashby; The chapel on the hill; Pinemoor; Birchley"),
}


@pytest.mark.parametrize("name", OTHERS)
def test_kinds_of_other_texts(name):
    """Texts of kinds that the corpus doesn't have."""
    kind, text = OTHERS[name]
    assert textstats.describe([text], corpus())["doc_kind"] == [kind]


def test_statistics(spark):
    rows = [(1, "One two three.\n\nFour five", "x", "clash"), (2, None, None, None), (3, PROSE * 2000, None, None), (4, "a\n" * 20_000, None, None), (5, "\n".join([PROSE] * 3), None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc_kind string, n_words string")
    got = {r.doc_id: r for r in textstats.text_statistics(df).collect()}
    assert got[1].n_words == 5 and got[1].mean_word_length == pytest.approx(19 / 5) and got[1].punctuated_line_share == 0.5
    assert got[1].symbol_ratio == pytest.approx(1 / 23) and got[1].common_word_share == pytest.approx(2 / 5)
    assert got[2].n_words == 0 and got[2].prose_share == 0 and got[2].doc_kind is None
    assert got[3].prose_share == 1 and got[5].prose_share == 1 and got[4].doc_kind == "junk"  # the same short line again and again
    assert all(sum(getattr(r, f"{s}_share") for s in textstats.STATES) == pytest.approx(1) for i, r in got.items() if i != 2)
    assert textstats.text_statistics(df.limit(0)).count() == 0


def _random_model(rnd):
    part = lambda *shape: np.log(np.random.default_rng(rnd.randrange(10**6)).dirichlet(np.ones(shape[-1]), shape[:-1]))
    return textstats.Model(part(1, 4)[0], part(2, 4, 4), tuple(part(4, n) for n in (len(textstats.FORMS), *(len(b) + 1 for b in textstats._BOUNDS))), {})


def _random_documents(rnd, sizes):
    docs = [[(*(rnd.randrange(n) for n in (10, 6, 4, 5)), rnd.randrange(2)) for _ in range(n)] for n in sizes]
    flat = np.array([x for d in docs for x in d]).reshape(-1, 5)
    return docs, flat[:, :4], flat[:, 4], np.array(sizes)


def _paths(model, doc):
    """Score of every path."""
    e = textstats._scores(model, np.array(doc)[:, :4])
    score = lambda p: model.start[p[0]] + sum(e[i][s] for i, s in enumerate(p)) + sum(model.move[doc[i + 1][4]][a][b] for i, (a, b) in enumerate(zip(p, p[1:])))
    return {p: score(p) for p in product(range(4), repeat=len(doc))}


def test_viterbi_is_the_best_path():
    rnd = random.Random(8)
    model = _random_model(rnd)
    docs, classes, apart, lengths = _random_documents(rnd, (3, 1, 5, 0, 4))
    labels, at = textstats.viterbi(model, classes, apart, lengths), 0
    for d in docs:
        if d:
            scores = _paths(model, d)
            assert scores[tuple(labels[at : at + len(d)])] == pytest.approx(max(scores.values()))
        at += len(d)


def test_expected_states_are_those_of_all_paths():
    rnd = random.Random(9)
    model = _random_model(rnd)
    docs, classes, apart, lengths = _random_documents(rnd, (2, 4, 0, 1, 3))
    states, moves, first = textstats._expect(model, classes, apart, lengths)
    want, turns, at = np.zeros_like(states), np.zeros_like(moves), 0
    for d in docs:
        if d:
            scores = _paths(model, d)
            whole = sum(map(math.exp, scores.values()))
            for p, s in scores.items():
                for i, a in enumerate(p):
                    want[at + i, a] += math.exp(s) / whole
                for i, (a, b) in enumerate(zip(p, p[1:])):
                    turns[d[i + 1][4], a, b] += math.exp(s) / whole
        at += len(d)
    assert np.allclose(states, want) and np.allclose(moves, turns) and first.sum() == pytest.approx(4)


def test_fit_makes_its_sample_likelier():
    texts = ["* Oakton\n* Elmford\n\n" + PROSE, PROSE + "\n" + PROSE, "a;1;2\nb;3;4\nc;5;6", "{{x}}\n| a = 1\n}}"] * 30
    stats, apart, _, lengths, _, _ = textstats._lines(texts, {})
    classes = textstats._classes(stats)
    best = lambda m: textstats._scores(m, classes)[np.arange(len(classes)), textstats.viterbi(m, classes, apart, lengths)].sum()
    assert best(textstats.fit(texts)) > best(textstats.at_start())
    assert textstats.fit([]).pairs == {} and textstats.fit([None, ""]).pairs == {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n.abÉΣςЯ\u0301日のカーンïĀ한글Ⅷİ\u00ad1"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_pairs_are_those_of_all_letters(texts):
    """Counted in arrays as by ``_letters``, but for Japanese letters, in whose lines none is looked up."""
    want = Counter()
    for t in texts:
        for pair in textstats._letters(t):
            first, second = (0 if textstats._JAPANESE.match(c) else ord(c) for c in pair)
            if first:
                want[first << 21 | second] += 1
    for size in (1 << 21, 5):
        textstats._PIECE, before = size, textstats._PIECE
        try:
            counts = textstats._PairCounts()
            counts.add(texts)
        finally:
            textstats._PIECE = before
        assert dict(zip(*counts.items())) == want


def test_statistics_are_fitted_to_all_documents(spark):
    """More documents than any sample had, of which one of over 50,000 characters alone shows what the language's letters are like."""
    rnd = random.Random(10)
    words = ["vlk", "čtvrť", "smršť", "žďár", "skříň", "řeřicha", "příští", "žížala", "ďáblů", "břízy"]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + " a to je dobré."
    texts = ["\n".join(line(12) for _ in range(900)), line(9), None, "", *(f"* Oakton {i}\n* Elmford" if i % 3 else PROSE for i in range(2500))]
    assert len(texts[0]) > 50_000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in textstats.text_statistics(df).collect()}
    model = textstats.fit(texts)
    want = textstats.describe(texts, model)
    assert len(got) == len(texts)
    for c, column in want.items():
        assert [got[i][c] for i in range(len(texts))] == [pytest.approx(x) if isinstance(x, float) else x for x in column]
    pairs = textstats._pair_chances(textstats.pair_counts(df))
    whole = textstats.fitted(textstats.seen(df, pairs), pairs)
    assert whole.pairs == model.pairs and all(np.allclose(a, b) for a, b in zip((whole.start, whole.move, *whole.emit), (model.start, model.move, *model.emit)))
    short = textstats.fit(t for t in texts if len(t or "") <= 50_000)
    assert textstats.describe([texts[1]], short)["doc_kind"] != [got[1].doc_kind]
