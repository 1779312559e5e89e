import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii, queries, toxicity

SCHEMA = "doc_id bigint, text string, score string, base int, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 3, "en") for i, t in rows], SCHEMA)


def base_by_hand(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub(r"\D", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "0", "255", "4111 1111 1111 1111", "-", " ", "+", "(", ")", "é", "\n", "b.c", "a@b.c", "+1 (988) 555-2485", "1.2.3.4", "٣", "😀"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_hand(text)


WEIGHTS = pii.train(sentences=300, rounds=3)


def test_field_on_unseen_sentences():
    """Precision and recall by kind, over all spans of fresh sentences."""
    rng, right, found, true = random.Random(5), Counter(), Counter(), Counter()
    for _ in range(400):
        text, spans = pii._made_up(rng)
        got = pii.segment(text, WEIGHTS)
        right.update(s[0] for s in set(got) & set(spans))
        found.update(s[0] for s in got)
        true.update(s[0] for s in spans)
    for kind in pii.KINDS:
        assert right[kind] / found[kind] > 0.9 and right[kind] / true[kind] > 0.9, kind


def segmentations(text):
    """Every list of spans with kinds that do not overlap, and its total weight."""
    spans = pii.candidates(text)
    exits, scores = pii._exits(text, spans), pii._scores(text, spans, WEIGHTS)
    into, out, between = pii._transitions(WEIGHTS)

    def after(last, start):  # (spans, total) of all ways to go on from candidate number start
        yield [], out[last[1]] if last else 0.0
        for c in range(start, len(spans)):
            if last and spans[c][0] < spans[last[0]][1]:
                continue
            for k in range(len(pii.KINDS)):
                if not last:
                    step = into[k]
                elif spans[c][0] <= exits[last[0]]:
                    step = between[last[1]][k]
                else:
                    step = out[last[1]] + into[k]
                for rest, total in after((c, k), c + 1):
                    yield [(pii.KINDS[k], *spans[c]), *rest], step + scores[c][k] + total

    return list(after(None, 0))


@pytest.mark.parametrize("text", ["call 555-123-4567 x", "1.2.3.4 5.6.7.8", "key: ab12cd34ef56 ok", "12 34", "bob at host dot com, +1 (555) 123-4567", "pwd=abcdef 7844238401328224"])
def test_field_equals_brute_force(text):
    ways = segmentations(text)
    best = max(ways, key=lambda w: w[1])
    totals = {tuple(spans): total for spans, total in ways}
    assert totals[tuple(pii.segment(text, WEIGHTS))] == pytest.approx(best[1])
    chart = pii.Chart(text, WEIGHTS)
    z = math.log(sum(math.exp(t - best[1]) for _, t in ways)) + best[1]
    assert chart.total == pytest.approx(z)
    shares = Counter()
    for spans, total in ways:
        shares.update({s: math.exp(total - z) for s in spans})
    assert pii.probabilities(text, WEIGHTS) == pytest.approx({s: shares[s] for s in pii.probabilities(text, WEIGHTS)}, abs=1e-9)


def test_training_follows_the_gradient():
    """The likelihood's slope in a few weights, by differences."""
    text, spans = "call 555-123-4567, bob(at)host.org", [("phone", 5, 17), ("email", 19, 34)]
    place = {s: c for c, s in enumerate(pii.candidates(text))}

    def likelihood(weights):
        chart = pii.Chart(text, weights)
        (a, j), (b, k) = [(place[s[1:]], pii.KINDS.index(s[0])) for s in spans]
        into, out, between = pii._transitions(weights)
        return into[j] + chart.score[a, j] + between[j][k] + chart.score[b, k] + out[k] - chart.total

    chart = pii.Chart(text, WEIGHTS)
    for f in ("dialled", "mail", pii.INTO, pii.OUT, "from:phone"):
        for k in range(len(pii.KINDS)):
            up, down = ({**WEIGHTS, f: [w + d * (i == k) for i, w in enumerate(WEIGHTS[f])]} for d in (1e-4, -1e-4))
            slope = (likelihood(up) - likelihood(down)) / 2e-4
            seen = {pii.INTO: chart.entered.sum(axis=0), pii.OUT: chart.left.sum(axis=0), "from:phone": chart.pairs[pii.KINDS.index("phone")]}.get(f)
            if seen is None:
                seen = sum(chart.shares[c] for c, fs in enumerate(chart.features) if f in fs)
            true = {"dialled": ["phone"], "mail": ["email"], pii.INTO: ["phone"], pii.OUT: ["email"], "from:phone": ["email"]}[f]
            assert slope == pytest.approx((pii.KINDS[k] in true) - seen[k], abs=1e-4)


@pytest.mark.parametrize("piece", ["10.2.3.4 ", "12 34 567 ", "a@b ", "at ", "key ", "+1 ", "x=1", "a1", "at at.at ", "password: "])
def test_long_texts_take_linear_time(piece):
    took = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        pii.find_spans(piece * n, WEIGHTS)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.5  # eight times the text


def test_pii_table(spark):
    rows = [(1, None), (2, ""), (3, "é mail a.b@c.de, ip 1.2.3.4 and 999.1.1.1"), (4, "x " * 50_000 + "a@b.cd"), (5, "tie 1.2.3.4"), (5, "tie 1.2.3.4"), (None, "password=b7db7aa4a5fcc78305 end"), (7, "1" * 5000)]
    got = pii.find_pii(docs(spark, rows), WEIGHTS)
    assert got.columns == ["doc_id", "text", "score", "lang", "base", "spans"]
    for r in got.collect():
        base = [tuple(s) for s in r.base]
        assert base == base_by_hand(r.text or "") and set(base) <= {tuple(s) for s in r.spans}
        added = [s for s in r.spans if tuple(s) not in base]
        assert not any(a.start < e and s < a.end for a in added for _, s, e in base)
        if r.doc_id is None:
            assert [r.text[s.start : s.end] for s in r.spans] == ["b7db7aa4a5fcc78305"]
    assert pii.find_pii(docs(spark, []), WEIGHTS).count() == 0


@pytest.mark.parametrize("text", ["You IDIOT!", "ｉｄｉｏｔ", "1d10t", "іdіоt here", "an id!ot", "ídiot", "id​iot"])
def test_folding(text):
    assert " idiot " in toxicity.fold(text)


def test_folding_leaves_numbers_alone():
    assert toxicity.fold("in 1999, $5 or 3.50") == " in 1999 5 or 3 50 "
    assert toxicity.fold("scum!! scum$$$") == " scum scum "


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " tra": 2.0}, ("trash can",), (-2.0, 1.0, 1.0), "t")
    assert lexicon.hits("trash") == (3.0, 300.0) and lexicon.hits("the trash can") == (0.0, 0.0)
    assert lexicon.hits("trash can trash")[0] == 3.0 and lexicon.hits(None) == (0.0, 0.0)
    assert lexicon.score("trash") > lexicon.score("trash " + "x " * 100) > lexicon.score("")


def test_toxicity_cases(spark):
    rows = [(1, None), (2, ""), (3, "such scum"), (None, "scum"), (4, "fine " * 30_000), (5, "tie scum"), (5, "tie scum")]
    rows += [(100 + i, f"word{i} scum other{i}" if i % 2 else f"word{i} fine other{i}") for i in range(60)]
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.score(docs(spark, rows), lexicon)
    assert got.columns == ["doc_id", "text", "base", "lang", "score"]
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.score >= 0.5) == ("scum" in (r.text or ""))
    none = toxicity.fit(docs(spark, rows), labels.limit(0))
    assert {r.score for r in toxicity.score(docs(spark, rows), none).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), lexicon).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").toPandas()
    toxic = found.toxic == 1
    assert (found.predicted == found.toxic).mean() > 0.97
    assert found.predicted[toxic].mean() > 0.9 and found.predicted[~toxic].mean() < 0.01


def naive_hits(lexicon, text):
    """Every entry at every place, by plain comparison."""
    folded = toxicity.fold(text)
    spared = [(i, i + len(e) + 1) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {e} ", i)]
    total = 0.0
    for i, c in enumerate(folded):
        if c == " " and not any(a <= i < b for a, b in spared):
            total += max((w for e, w in lexicon.entries.items() if folded.startswith(e, i)), default=0.0)
    for word in toxicity.endings(text):
        total += max((w for e, w in lexicon.entries.items() if word.startswith(e)), default=0.0)
    return total


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "tra", "scum", "scu", "a$$", "a55", "ass", "trash5", "sc", "um", " ", " ", ", ", "5", "$", "é", "trashy"]), max_size=10).map("".join))
def test_matching_equals_naive_search(text):
    lexicon = toxicity.Lexicon({" trash ": 3.0, " tra": 2.0, " scum ": 4.0, " ass ": 2.5, " scu": 1.0}, ("trash can", "can scum"), (-2.0, 1.0, 1.0), "naive")
    assert lexicon.hits(text)[0] == pytest.approx(naive_hits(lexicon, text))


def test_word_endings():
    lexicon = toxicity.Lexicon({" ass ": 2.5, " scum ": 4.0}, (), (-2.0, 1.0, 1.0), "ends")
    assert lexicon.hits("a$$")[0] == lexicon.hits("such an a55, yes")[0] == 2.5
    assert lexicon.hits("scum$$$")[0] == 4.0 and lexicon.hits("gas55 a1b2")[0] == 0.0


def test_exceptions_are_learned(spark):
    rows = [(i, f"word{i} scum other{i}") for i in range(40)] + [(100 + i, f"word{i} scum bag{i % 16} fine other{i}" if i % 16 == 0 else f"word{i} nice other{i}") for i in range(200)]
    rows = [(i, t.replace("bag0", "bag")) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs(spark, rows), labels)
    assert "scum bag" in lexicon.exceptions and lexicon.hits("a scum bag here")[0] == 0.0 and lexicon.hits("such scum here")[0] > 0
