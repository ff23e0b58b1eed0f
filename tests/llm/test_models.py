"""Toxicity, quality and contamination: brute force where results are exact, held-out accuracy where they are learned."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import decontaminate, quality_rules, site_quality, toxicity

from .conftest import WORDS, prose


@pytest.fixture(scope="module")
def judged(spark):
    """Documents and labels: some have a sentence with a bad word, others are lists of symbols."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        text, toxic, good = prose(rng, 120), int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            text += f"\nYou {rng.choice(['scumlike', 'vileish', 'foulest'])} thing."
        if not good:
            text = "\n".join(" | ".join(w + "***" for w in line.split()) for line in text.split("\n"))
        rows.append((i, text, "site%d" % (i % 7), "en", 3))
        labels.append((i, good, toxic))
    labels += [(None, 1, 1), (3, None, None), (10**6, 0, 1)]
    rows += [(900, None, None, None, 0), (901, "", "new", "xx", 0), (None, " \n", "site1", "en", 0), (5, rows[5][1], "site5", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `score.d x` int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (g, t) for i, g, t in labels if g is not None and i}


def test_toxicity_is_learned_from_document_labels(judged):
    docs, labels, truth = judged
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    wrong = sum(r.predicted != truth[r.doc_id][1] for r in found if r.doc_id in truth)
    assert wrong <= 6
    assert all(r.score == 0 for r in found if r.doc_id in (900, 901, None))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        for span in r.offending if r.predicted and truth[r.doc_id][1] else []:
            assert re.search("scumlike|vileish|foulest", texts[r.doc_id].encode()[span.begin : span.end].decode())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in found)


def test_held_out_labels_are_never_learned(judged, spark):
    docs, labels, _ = judged
    inside = labels.where(~toxicity.held_out())
    score = lambda given: sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, given).collect())
    assert score(labels) == score(inside)


def test_empty_tables(judged):
    docs, labels, _ = judged
    nothing = docs.where("false")
    assert toxicity.toxicity_digests(nothing, labels).collect() == []
    assert quality_rules.quality(nothing, labels).collect() == [] and site_quality.site_quality(nothing, labels).collect() == []
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}
    assert quality_rules.quality(docs, labels.where("false")).count() == docs.count()
    assert site_quality.site_quality(docs, labels.where("false")).count() == docs.count()


def test_quality_counts_and_verdicts(judged):
    docs, labels, truth = judged
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = quality_rules.quality(docs, labels).collect()
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        threes = Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for d in range(3)}
        seen, again = set(), 0
        for line in texts[r.doc_id].split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        symbols = sum(c in "#*$%&|<>" for c in texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), symbols, again, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert sum(r.kept != bool(truth[r.doc_id][0]) for r in found if r.doc_id in truth and not r.base_failed) <= 6


def test_viterbi_takes_the_best_path():
    import itertools

    rng = random.Random(7)
    for _ in range(50):
        chain = quality_rules.Chain(np.zeros(1), np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]), np.array([rng.gauss(0, 1), rng.gauss(0, 1)]))
        scores = [rng.gauss(0, 2) for _ in range(6)]
        worth = lambda path: chain.start[path[0]] + sum(s for s, y in zip(scores, path) if y) + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=6), key=worth)
        assert quality_rules.viterbi(scores, chain) == list(best)
    assert quality_rules.viterbi([], chain) == []


def test_sites_shrink_toward_what_lies_above(judged, spark):
    docs, labels, truth = judged
    found = site_quality.site_quality(docs, labels).collect()
    assert len(found) == docs.count()
    assert sum(r.kept != bool(truth[r.doc_id][0]) for r in found if r.doc_id in truth) <= 6
    alone = [r for r in found if r.doc_id == 901][0]
    everywhere = sum(r.evidence for r in found) / len(found)
    assert abs(alone.host_rate - everywhere) < 1e-6 and abs(alone.path_rate - everywhere) < 1e-6
    rows = [(i, "x", "bad" if i % 2 else "fine", "p") for i in range(40)] + [(99, "x", "bad", "other")]
    fixed = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    rates = {r.doc_id: r.host_rate for r in site_quality.site_quality(fixed, labels.where("false")).collect()}
    assert len(set(rates.values())) == 1  # the same evidence everywhere: no site differs


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, how = rng.randrange(len(words)), rng.choice("sid")
        words[at : at + (how != "i")] = [] if how == "d" else ["w%d" % rng.randrange(10**6)]
    return words


def test_items_are_found_with_words_changed(spark):
    rng = random.Random(21)
    items = [(n, " ".join("w%d" % rng.randrange(500) for _ in range(rng.randrange(8, 60)))) for n in range(40)]
    items += [(50, "three little words"), (51, "too short"), (52, None), (None, "no id at all"), (0, items[0][1])]
    rows, want = [], {}
    for n, (item, text) in enumerate(items[:41] * 5):
        words = text.split()
        changed = edited(rng, words, rng.randrange(decontaminate.edits_allowed(len(words)) + 1))
        rows.append((n, prose(rng, rng.randrange(0, 80)) + " " + " ".join(changed).upper() + "\t" + prose(rng, rng.randrange(0, 80)), "f"))
        want[n] = item
    clean = [(1000 + n, prose(rng, 200), "f") for n in range(50)] + [(1100, None, "f"), (1101, "", "f"), (None, "three little words", "f")]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string, f_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    hit = sum(want[n] in got[n].item_ids for n in want)
    assert hit >= 0.97 * len(want)
    assert not any(got[n].contaminated for n, *_ in clean if n) and got[None].item_ids == [50]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got.values())
    assert decontaminate.contamination_report(docs.where("false"), bench).collect() == []
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize("size", [8, 20, 38, 59, 120, 250])
def test_items_with_words_deleted_are_found_at_the_very_beginning(size):
    rng = random.Random(size)
    words = [["w%d" % rng.randrange(10**6) for _ in range(size)] for _ in range(40)]
    items = decontaminate.build_items(list(range(40)), [" ".join(w) for w in words])
    texts = []
    for own in words:
        gone = set(rng.sample(range(size), decontaminate.edits_allowed(size)))
        texts.append(" ".join([w for k, w in enumerate(own) if k not in gone] + ["v%d" % rng.randrange(10**6) for _ in range(rng.choice([0, 3, 300]))]))
    found = decontaminate.leaks(items, *decontaminate._words(pa.array(texts)))
    assert {(t, i) for t, i, _, _ in found} == {(k, k) for k in range(40)}
    alone = [decontaminate._words(pa.array([t]))[0] for t in texts]
    for t, i, end, edits in found:
        assert decontaminate.best_match(items.words[i], alone[t])[0] == edits == decontaminate.best_match(items.words[i], alone[t][:end])[0]
    assert decontaminate.leaks(items, np.zeros(0, np.uint64), np.zeros(1, np.int64)) == []


def test_leaks_equal_the_edit_distance_of_every_item():
    """Few different words, so that many windows hold many of an item's 3-grams without being within reach."""
    rng = random.Random(31)
    words = ["w%d" % k for k in range(12)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    own = [pick(rng.randrange(3, 40)) for _ in range(40)]
    items = decontaminate.build_items(list(range(40)), [" ".join(w) for w in own])
    texts = []
    for w in own * 3:
        n = decontaminate.edits_allowed(len(w))
        texts.append(" ".join(pick(rng.choice([0, 5, 60])) + edited(rng, w, rng.randrange(n, n + 3)) + pick(rng.choice([0, 40]))))
    found = {(t, i) for t, i, _, _ in decontaminate.leaks(items, *decontaminate._words(pa.array(texts)))}
    alone = [decontaminate._words(pa.array([t]))[0] for t in texts]
    want = {(t, i) for t, text in enumerate(alone) for i, w in enumerate(items.words) if decontaminate.best_match(w, text)[0] <= decontaminate.edits_allowed(len(w))}
    assert found == want


def test_distance_is_exact():
    rng = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in "ab")
        assert decontaminate.best_match(np.array(a), np.array(b))[0] == plain(a, b)


def test_word_pieces_are_bytes_without_ascii_marks():
    bags = toxicity.sentences(pa.array(["One two. Three!", "", "é ü", "..."]))
    assert bags.text.tolist() == [0, 0, 2] and WORDS


MENU = ["Home | About | Contact | Login", "* * * Share this * * *", "Copyright 2021 ### All rights reserved 123", "Next >> Previous << Top", "$$ BUY 50% OFF $$ | order #1"]


def both_kinds(rng, n):
    """Lines of prose with stretches of menus between; and which are menus."""
    lines, menu = [], []
    while len(lines) < n:
        here = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4)):
            lines.append(rng.choice(MENU) if here else prose(rng, 14).replace("\n", " ") + ".")
            menu.append(here)
    return lines, menu


def test_boilerplate_inside_good_documents_is_marked_line_by_line():
    """Only documents are labelled: good ones are prose with some menus, bad ones menus with some prose."""
    rng = random.Random(12)
    texts, bad = [], []
    for k in range(300):
        lines, menu = both_kinds(rng, 16)
        chosen = [line for line, m in zip(lines, menu) if m == (k % 2 == 1) or rng.random() < 0.25]
        texts.append("\n".join(chosen))
        bad.append(k % 2)
    chain = quality_rules.fit(texts, bad, [1.0] * len(texts))
    (cc, cb), (bc, bb) = chain.steps
    assert cc > cb and bb > bc  # like follows like, as in the training texts
    right = total = mixed = 0
    for _ in range(60):
        lines, menu = both_kinds(rng, 20)
        found = quality_rules.measure(pa.array(["\n".join(lines)]))
        labels = quality_rules.label_lines(found, chain).tolist()
        right += sum(a == b for a, b in zip(labels, menu, strict=True))
        total += len(menu)
        mixed += 0 < sum(labels) < len(labels)
    assert right >= 0.95 * total and mixed >= 55


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(10):
        chain = quality_rules.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores, used = rng.normal(size=(1, 5, 2)) * 2, np.array([[True] * 4 + [False]])
        at, pair = quality_rules.marginals(scores, used, chain)
        paths = list(itertools.product((0, 1), repeat=4))
        worth = [np.exp(chain.start[p[0]] + sum(scores[0, t, y] for t, y in enumerate(p)) + sum(chain.steps[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        for t in range(4):
            for y in (0, 1):
                assert np.isclose(at[0, t, y], sum(w for p, w in zip(paths, worth) if p[t] == y) / sum(worth))
        for t in range(3):
            for y in itertools.product((0, 1), repeat=2):
                assert np.isclose(pair[0, t, y[0], y[1]], sum(w for p, w in zip(paths, worth) if p[t : t + 2] == y) / sum(worth))
        assert not at[0, 4].any() and not pair[0, 3].any()


def test_verdicts_equal_plain_decoding(judged):
    """``kept`` and ``content_share`` from the fitted weights, with every path of a short document tried."""
    import itertools

    docs, labels, _ = judged
    chain = quality_rules.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.quality(docs, labels).collect():
        found = quality_rules.measure(pa.array([texts[r.doc_id]]))
        scores = chain.lines[quality_rules.one_hot(found.line_bins)].sum(axis=1)
        if len(scores) > 10:
            continue
        worth = lambda p: sum(scores[t] for t, y in enumerate(p) if y) + (chain.start[p[0]] if p else 0) + sum(chain.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(scores)), key=worth)
        share = sum(n for n, y in zip(found.line_words, best) if not y) / max(1, r.n_words)
        assert abs(share - r.content_share) < 1e-12 and r.kept == (not r.base_failed and share >= 0.5)
