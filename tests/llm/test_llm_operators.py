"""The training-data operators of the llm subpackage: brute force, round trips, held-out accuracy, odd cases."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lookalike, mixing, packing, radix, residue, survivor, tokens

WORK = "work_id string, title string, doi string, key string, bucket int, copies int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_trie_counts_any_keys():
    rnd = random.Random(2)
    keys = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(7))) for _ in range(3000)] + [b"", b"a" * 5000, b"a" * 4999]
    t, want = radix.Trie(), defaultdict(list)
    for i, k in enumerate(keys):
        t.add(k, 1, f"{i:05d}")
        want[k].append(f"{i:05d}")
    assert sorted(t.terminals()) == sorted((k, len(v), min(v)) for k, v in want.items()) and t.size == len(want)


@pytest.mark.parametrize("kw", [{}, {"capacity": 3, "step": 1}])
def test_duplicates_by_formatting(spark, kw):
    data = [
        ("W1", "Über  Maps: a study", "https://doi.example/10.5/AB"), ("W2", "«ÜBER MAPS A STUDY»", "doi: 10.5/ab."), ("W3", "Uber maps a study", "10.5/ab"), ("W4", "über maps a study", None), ("W5", "über maps, a study", " "),
        ("W6", None, "10.5/ab"), (None, "über maps a study", "10.5/ab"), ("W1", "Über  Maps: a study", "https://doi.example/10.5/AB"), ("W7", "", None), ("W8", "?!", ""), ("W9", "Straße", "1"), ("W10", "STRASSE", "1"),
        ("W11", "x" * 200_000, None), ("W12", "X" * 200_000 + ".", None),
    ]
    df = spark.createDataFrame([(*d, "k", 1, 1) for d in data], WORK)
    want = [("W1", "W2"), ("W10", "W9"), ("W11", "W12"), ("W4", "W5"), ("W7", "W8")]
    assert rows(radix.duplicate_pairs(df, **kw)) == want
    one = {r.work_id: r.work_id_count for r in radix.duplicate_works(df, **kw).collect()}
    assert one == {"W1": 2, "W3": 1, "W4": 2, "W7": 2, "W10": 2, "W11": 2}
    assert len(rows(radix.duplicate_membership(df, **kw))) == 11


def test_duplicates_hot_group_and_empty(spark):
    df = spark.createDataFrame([(f"W{i:04d}", "Same title" + "." * (i % 5), None, None, None, None) for i in range(80)] + [(f"V{i}", f"t{i}", None, None, None, None) for i in range(100)], WORK)
    assert radix.duplicate_pairs(df, capacity=10, step=1).count() == 80 * 79 // 2
    assert radix.duplicate_pairs(spark.createDataFrame([], WORK)).count() == 0


def test_work_of_a_frequent_key_does_not_grow_with_its_length(spark):
    def jobs(length, tail):
        data = [(f"W{i}", "t" * length + (f"{i:05d}" if tail else ""), None, None, None, None) for i in range(1200)]
        spark.sparkContext.setJobGroup(f"g{length}{tail}", "")
        n = radix.duplicate_membership(spark.createDataFrame(data, WORK), capacity=100).select("representative_work_id").distinct().count()
        assert n == (1200 if tail else 1)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{length}{tail}"))

    assert jobs(60, False) == jobs(6000, False)
    assert jobs(60, True) == jobs(6000, True)  # all keys share all but their last bytes
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


REC = "record_id long, institution_id string, metadata_source string, openalex_updated_date string, source_display_names array<string>, source_country_codes array<string>, source_institution_types array<string>, source_ror_ids array<string>, field_name string, value int"


def test_survivors(spark):
    trust = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 0)], "metadata_source string, trust_rank int")
    data = [
        (1, "I1", "b", "2024-01-01", ["Name"], ["ZZ", "", "??"], None, ["https://ror.example/"]), (2, "https://x/I1/", "a", None, ["N/A", None, " "], ["DE"], [], ["https://ROR.example/0abc"]), (3, " I1", None, "2025-01-01", ["Newer"], ["FR"], ["other"], None),
        (3, " I1", None, "2025-01-01", ["Newer"], ["FR"], ["other"], None), (4, "I2", "a", None, ["Alone"], None, None, None), (5, "I3", "b", "2024-01-01T00:00:00+02:00", ["x y"], None, None, None), (6, "I3", "b", "2023-12-31T23:00:00Z", ["y z"], None, None, None),
        (7, None, "a", None, ["No"], None, None, None), (None, "I3", "a", None, ["No"], None, None, None), (9, "I4", "a", None, ["t"], None, None, None), (8, "I4", "a", None, ["t"], None, None, None),
    ]
    df = spark.createDataFrame([(*d, "f", 1) for d in data], REC)
    got = rows(survivor.field_survivors(df, trust))
    assert got == [("I1", "source_country_codes", 2), ("I1", "source_display_names", 1), ("I1", "source_institution_types", 3), ("I1", "source_ror_ids", 2), ("I3", "source_display_names", 6), ("I4", "source_display_names", 8)]
    full = {r.institution_id: r for r in survivor.surviving_records(df, trust).collect()}
    assert full["I1"].completeness == 4 and full["I1"].source_country_codes == ["DE"] and full["I2"].record_count == 1
    assert survivor.field_survivors(spark.createDataFrame([], REC), trust).count() == 0 and survivor.surviving_records(spark.createDataFrame([], REC), trust).count() == 0


def test_forms_agree_with_unicode(spark):
    texts = ["plain  ascii\t x ", "Ｆｕｌｌ　ｗｉｄｔｈ", "café", "café", "аео", "zero​width﻿", "ﬁeld Ⅱ", "ạ̇", "ạ̇", "한글", "한글", "x²", "", " ", "​", "a" * 100_000 + "́", "\U0001d400", "é" * 2000, "Å", "ё", "ế", "e\u0323\u0302\u0301\u0308\u0331", "a" + "\u0301" * 40 + "\u0323", "s\u0307\u0323\u0307", "\u09c7\u09be", "\u0301x", "\u1112\u1161\u11ab\u0301", "\u01d6\u0323"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate([*texts, None])], "k int, text string, form string")
    got = {r.k: r.form for r in lookalike.unified_column(df, "k", "text").collect()}
    like = {chr(a): chr(b) for a, b in lookalike.look_alikes().items()}
    for i, t in enumerate(texts):
        s = unicodedata.normalize("NFKD" if t != "x²" else "NFD", t)
        s = "".join(like.get(c, " " if unicodedata.category(c) == "Zs" else c) for c in s if unicodedata.category(c) != "Cf")
        assert got[i] == " ".join(unicodedata.normalize("NFC", s).split()), t[:30]
    assert got[len(texts)] is None


def test_recomposition_of_any_number_of_marks(spark):
    rnd = random.Random(9)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.normalize("NFC", chr(c)) == chr(c)] + list("\u05b0\u05b4\u0f71\u0f72\u0301\u0323\u0307")
    texts = ["".join(rnd.choice("aeiouAEsSw가각ᄒ") + "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 1, 2, 5, 9]))) for _ in range(6)) for _ in range(300)]
    texts = sorted({t for t in texts if not set(unicodedata.normalize("NFD", t)) & set("\u034f")})
    got = {r.text: r.form for r in lookalike.unify_texts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert all(got[t] == unicodedata.normalize("NFC", t) for t in texts)


def test_look_alike_pairs_odd_cases(spark):
    data = [("1", "Map II"), ("2", "Map Ⅱ"), ("3", "Map  II"), ("4", "map II"), ("5", "Mаp II"), ("6", None), ("7", "Mаp II"), (None, "Map Ⅱ"), ("8", "Mäp"), ("1", "Map II")]
    df = spark.createDataFrame([(*d, "x") for d in data], "k string, t string, form string")
    got = rows(lookalike.look_alike_pairs(df, "k", "t"))
    assert got == [("1", "2"), ("1", "5"), ("1", "7"), ("2", "3"), ("2", "5"), ("2", "7"), ("3", "5"), ("3", "7")]
    assert lookalike.look_alike_pairs(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


@pytest.mark.parametrize("caps", [[10], [5, 10, 30], [7, 11]])
def test_best_fit_is_valid_and_tight(caps):
    rnd = random.Random(sum(caps))
    sizes = [rnd.randrange(1, max(caps) + 1) for _ in range(700)]
    place, boxes = packing.best_fit(sizes, caps)
    used = defaultdict(int)
    for s, b in zip(sizes, place):
        used[b] += s
    for b, (c, u) in enumerate(boxes):
        assert u == used[b] <= c in caps and all(k >= c or k < u for k in caps)
    assert sum(c for c, _ in boxes) < 1.06 * sum(sizes)
    assert packing.best_fit([], caps) == ([], [])


def test_pack_splits_only_what_exceeds(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 10), (3, 4), (4, 0), (5, 1), (6, 11), (7, None)], "doc_id long, tokens int").withColumn("packing", F.lit("x"))
    p = packing.pack(sizes, {"s": 10, "l": 20}, shard_items=3).toPandas()
    for name, most in (("s", 10), ("l", 20), ("mixed", 20)):
        own = p[p["packing"] == name]
        assert own.groupby("doc_id")["piece_tokens"].sum().to_dict() == {1: 25, 2: 10, 3: 4, 5: 1, 6: 11}
        assert (own.groupby("doc_id").size() == own.groupby("doc_id")["piece_tokens"].sum().map(lambda t: -(-t // most))).all()
        assert (own.groupby("container_id")["piece_tokens"].sum() <= own.groupby("container_id")["capacity_tokens"].first()).all()
    assert packing.pack(sizes.filter("false"), {"s": 10}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, {})


def test_token_counts_of_parts_are_those_of_the_whole():
    with open(tokens.RANKS, "rb") as f:
        raw = f.read()
    enc, count = tokens.encoder(raw), tokens.counter(raw)
    rnd = random.Random(1)
    texts = ["ab cd " * 200_000, "ab cd " * 180_001 + "   \n\n" * 90_000 + " x'll", "1234567 " * 130_000, "漢字、仮名。" * 200_000, "".join(rnd.choice(["word", " ", "\n", "'s", "12", ", ", "é", "\t"]) for _ in range(500_000)), "x y" + " " * 70_000 + "z" + "\n" * 60_000 + "\nq" + " " * 60_000]
    for t in texts:
        assert "".join(x for _, x in tokens.parts(t)) == t and count(t) == len(enc.encode_ordinary(t)), t[:20]
    assert sum(1 for _ in tokens.parts(texts[0])) == 2 and count("x" + " " * 1_500_000 + "z") > 10


def test_token_counts_whole_texts(spark):
    long = "ab cd " * 300_000
    df = spark.createDataFrame([(1, "one two three"), (2, long), (3, None), (4, "  \n"), (5, "")], "doc_id long, text string")
    got = dict(tokens.token_counts(df, "doc_id", "text").select("doc_id", "tokens").collect())
    assert set(got) == {1, 2} and got[1] == 3 and got[2] > 600_000


DOC = "doc_id long, text string, source string, repeats int, tokens string"


def test_mix_reaches_shares_within_caps(spark):
    rnd = random.Random(5)
    words = {"a": "river delta flood water", "b": "court law judge trial", "c": "cell gene protein dna", "no": "buy cheap now"}
    data, i = [], 0
    for s, n in (("a", 400), ("b", 60), ("c", 200), ("no", 100)):
        for _ in range(n):
            i += 1
            data.append((i, " ".join(rnd.choice(words[s].split()) for _ in range(rnd.randrange(5, 60))), s if rnd.random() > 0.1 else None, 1, "t"))
    data += [(9001, None, "a", 1, "t"), (9002, "  ", "b", 1, "t"), (9003, "river " * 20_000, "a", 1, "t")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(spark.createDataFrame(data, DOC), targets)
    assert max(abs(r.expected_gap) for r in shares.collect()) < 0.01
    got = {r.source: r for r in shares.collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s].actual_share - want / 0.9) < 0.01, got
    assert got["gone"].token_count == 0 and got["no"].token_count == 0
    cap = {"a": 1, "b": 3, "c": 2}
    rows_ = chosen.collect()
    assert all(1 <= r.repeats <= cap[r.domain] for r in rows_) and len({r.doc_id for r in rows_}) == len(rows_)
    truth = {i: s for s, (lo, hi) in {"a": (1, 400), "b": (401, 460), "c": (461, 660)}.items() for i in range(lo, hi + 1)}
    assert all(truth.get(r.doc_id, "a") == r.domain for r in rows_ if r.source is None)  # held-out labels
    small, _ = mixing.mix(spark.createDataFrame(data, DOC), targets, total_tokens=2000)
    assert abs(sum(r.tokens * r.repeats for r in small.collect()) - 2000) < 150


def test_mix_is_decided_by_the_fitted_rates(spark, monkeypatch):
    rnd = random.Random(8)
    words = {"a": "river delta flood water basin", "b": "court law judge trial appeal"}
    data = [(i, " ".join(rnd.choice(words[w].split()) for _ in range(12)), s, 1, "t") for i, (w, s) in enumerate([("a", "a")] * 150 + [("b", "b")] * 150 + [("b", "a")] * 25)]
    docs, targets = spark.createDataFrame(data, DOC), spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets, label_noise=0.2)
    rate = {r.doc_id: r.rate for r in chosen.collect()}
    odd = [rate.get(i, 0.0) for i in range(300, 325)]
    assert len({round(x, 6) for x in rate.values()}) > 2 and min(rate.get(i, 0.0) for i in range(150)) > max(odd)  # one label, rates by text
    assert {r.source: r.documents for r in shares.collect()}["a"] > 100
    monkeypatch.setattr(mixing, "fit_rates", lambda *a, **k: [])
    without = {(r.doc_id, r.repeats) for r in mixing.mix(docs, targets, label_noise=0.2)[0].collect()}
    assert len(without) == len(data) and without != {(i, 1) for i in rate}


def test_mix_empty_tables(spark):
    t = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], DOC)
    assert mixing.mix(none, t)[0].count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "x y", "a", 1, "t")], DOC), t.filter("false"))[0].count() == 0


def _corpus(rnd, n):
    real = ["The survey of {} used paper forms in the valley.", "We tested {} kernels and kept the one with the lowest error.", "Costs near the river dropped by {} percent once volunteers helped.", "Der Bericht von {} beschreibt die Lage im Tal und am Fluss."]
    quote = ["The form fills placeholders such as {{ title }} or ${region} from the table.", "The script prints '%d parcels in %s' and stops when the ratio is undefined.", "The viewer requires JavaScript, so {} offices used the printed atlas instead."]
    junk = ["Please enable JavaScript to view this page.", "404 Not Found\nThe requested item was not found on this server.", "Abstract goes here. Keep it under 250 words.", "Oops! Something went wrong. Try again later.", "Lorem ipsum dolor sit amet consectetur elit sed tempor magna."]
    slots = ["{{ %s }}", "${item.%s}", "[insert %s]", "<%%= %s %%>", "[[%s]]", "@@%s@@"]
    docs, bad = [], set()
    for i in range(n):
        body = [rnd.choice(real).format(rnd.randrange(9, 999)) for _ in range(rnd.randrange(2, 7))]
        kind = rnd.random()
        if kind < 0.15:
            body, _ = [rnd.choice(junk)], bad.add(i)
        elif kind < 0.25:
            w = body[0].split()
            w[rnd.randrange(len(w) - 1)] = rnd.choice(slots) % rnd.choice(["title", "region", "year", "doi"])
            body[0], _ = " ".join(w), bad.add(i)
        elif kind < 0.45:
            body.insert(1, rnd.choice(quote).replace("{}", str(rnd.randrange(99))) if rnd.random() < 0.7 else junk[0])
        docs.append((i, " ".join(body) if rnd.random() < 0.5 else "\n".join(body)))
    return docs, bad


def test_residue_on_held_out_documents(spark):
    docs, bad = _corpus(random.Random(3), 1500)
    odd = [(90_001, None), (90_002, " \n"), (90_003, "The survey of 7 used paper forms in the valley. " * 20_000)]
    df = spark.createDataFrame([(*d, "r") for d in docs + odd], "doc_id long, text string, residue string")
    got = {r.doc_id for r in residue.residue_found(df, fit_docs=700).collect()}  # more than half is never seen in the fit
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 0.01 * len(docs)
    clean = residue.clean_documents(df, fit_docs=700)
    assert clean.count() == len(docs) + 3 - len(got) and clean.columns == df.columns


def test_residue_slots_of_any_form():
    trusted = lambda t: any(sure for sure, _ in residue.slot_features(t))
    text = "We mapped land cover in two regions. {} The results agree with the field survey."
    long = "[Insert the full name and postal address of the responsible institution and of the person who answers for the data here]"
    slots = (long, long.replace(" and postal", ". Then the postal"), long.replace(" and of", "\nand of"), "[The name\ngoes here]", "<enter the title.\nThen the year>", "<% render the list of all records. of this page and of all the pages behind it %>")
    assert all(trusted(text.format(x)) for x in slots)
    real = ("[12] and [13, 14]. ", "The form says '" + long + "' there. ", "[see the survey. It has all of the figures] ", "a < b. Then c > d. ")
    assert not any(trusted(text.format(x)) for x in real)


def test_residue_verdicts_do_not_depend_on_other_rows():
    docs, _ = _corpus(random.Random(4), 300)
    texts = [t for _, t in docs] + ["Name: {{ " + "a" * n + "1234567 }} of the list." for n in (20, 50, 55, 60)]
    rnd = np.random.default_rng(1)
    words = rnd.normal(0, 1, (residue.BUCKETS, 3)).astype(np.float32)
    model = residue.Model(words, np.log([0.7, 0.3]), -2.0, rnd.normal(0, 1, residue.BUCKETS), 0.5)
    alone = [tuple(float(x[0]) for x in residue.score([t], model)) for t in texts]
    together = list(zip(*map(list, residue.score(texts, model))))
    back = list(zip(*map(list, residue.score(texts[::-1], model))))[::-1]
    for a, b, c in zip(alone, together, back):
        assert np.allclose(a, b, atol=1e-3) and np.allclose(a, c, atol=1e-3)


def test_passages_are_whole_and_distinct():
    long = "The survey covers the valley. " * 80_000 + "x" * 1_300_000 + "\nLast line here"
    ps = residue.passage_features(["", "One two. One two. Three!", long, " ", "One two"])
    assert ps.doc.tolist()[:2] == [1, 1] and ps.repeats.tolist()[:2] == [2, 1] and ps.doc.tolist()[-1] == 4
    own = ps.words[ps.doc == 2]
    assert ps.repeats[ps.doc == 2].sum() >= 80_000 and own[0] == 5 and own[-1] == 3 and len(ps.f) == ps.size.sum()


def test_residue_empty(spark):
    assert residue.residue_found(spark.createDataFrame([], "doc_id long, text string")).count() == 0
