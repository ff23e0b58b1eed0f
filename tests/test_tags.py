import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagweave.catalog import queries
from tagweave.functions import ordering
from tagweave.operators import counts, stem, tags

# Words and their published stems, departures of the toolkit version among them.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall",
    "hissing": "hiss", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formality": "formal", "sensibility": "sensibl", "triplicate": "triplic", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
    "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controlling": "control", "roll": "roll", "sky": "sky", "skies": "sky", "dies": "die", "ties": "tie",
    "died": "die", "tied": "tie", "dying": "die", "tying": "tie", "news": "news", "inning": "inning",
    "succeed": "succeed", "tried": "tri", "cries": "cri", "sunday": "sunday", "play": "play", "use": "use",
    "alternative": "altern", "oldies": "oldi", "gorgeous": "gorgeou", "viking": "vike", "by": "by",
}
TAGS = {
    "Acoustic Guitars": "acoustguitar", "Progressive-Rock": "progressrock", "80s": "80", "R&B": "rb",
    "a subtle use of vocal harmonies": "asubtluseofvocalharmoni", "Adult Contemporary": "adultcontemporari",
    "female vocalists": "femalvocalist", "---": "", "Ünder Ground": "ünderground", "easy listening": "easilisten",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "raw string")
    got = {r.raw: r.tag for r in df.select("raw", tags.normalize_tag(F.col("raw")).alias("tag")).collect()}
    assert got == STEMS


def test_tags(spark):
    df = spark.createDataFrame([(w,) for w in TAGS], "raw string")
    got = {r.raw: r.tag for r in df.select("raw", tags.normalize_tag(F.col("raw")).alias("tag")).collect()}
    assert got == TAGS


def raw(spark):
    rows = [(1, "Rock"), (1, "rocks"), (1, "jazz!"), (2, "rock"), (2, "--"), (3, "folk"), (3, "Folk"), (3, "rock")]
    return spark.createDataFrame(rows, "track long, raw string")


def test_vocabulary_bags_and_their_complement(spark):
    counted = tags.normalize_tags(raw(spark))
    assert {(r.track, r.tag, r.n) for r in counted.collect()} == {
        (1, "rock", 2), (1, "jazz", 1), (2, "rock", 1), (3, "folk", 2), (3, "rock", 1)
    }
    vocab = tags.build_tag_vocab(counted, 2)
    assert [(r.tag, r.n_tracks) for r in vocab.collect()] == [("rock", 3), ("folk", 1)]
    assert tags.build_tag_vocab(counted, 10, min_tracks=2).count() == 1
    ids = tags.encode_tag_ids(vocab)
    assert {r.tag: r.tag_id for r in ids.collect()} == {"folk": 0, "rock": 1}
    bags = tags.bag_of_tags(counted, ids)
    assert {tuple(r) for r in bags.collect()} == {(1, 1, 2), (2, 1, 1), (3, 0, 2), (3, 1, 1)}
    assert tags.tags_in_vocab(counted, ids).count() == 4
    assert [r.tag for r in tags.tags_out_of_vocab(counted, ids).collect()] == ["jazz"]


def test_words_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "a b\n\tc  a"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(r.raw for r in tags.words_of(df, "doc_id").collect()) == ["a", "a", "b", "c"]


def test_count_matrix_sums_duplicates(spark):
    events = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, "y", 0.0)], "r long, c string, v double")
    assert [tuple(r) for r in counts.count_matrix(events, "r", "c", F.col("v")).collect()] == [(1, "x", 5.0)]
    assert {tuple(r) for r in counts.count_matrix(events, "r", "c").collect()} == {(1, "x", 2.0), (2, "y", 1.0)}


def test_number_labels(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "Z", "b", "é"]], "name string")
    assert {r.label: r.d for r in counts.number_labels(df, "name").collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}


def test_joint_matrix(spark):
    codes = spark.createDataFrame([(1, 0, 4)], "track long, code int, n long")
    bags = spark.createDataFrame([(1, 0, 2), (2, 3, 1)], "track long, tag_id int, n long")
    assert {tuple(r) for r in counts.joint_matrix(codes, bags, 8).collect()} == {(1, 0, 4.0), (1, 8, 2.0), (2, 11, 1.0)}


@pytest.mark.parametrize("counters", [1, 5, 40, 1 << 16])
@pytest.mark.parametrize("n_tags, min_tracks", [(3, 1), (12, 1), (12, 6), (500, 1)])
def test_vocabulary_from_few_counters_is_exact(spark, counters, n_tags, min_tracks):
    """Tags of falling frequency over parts that each favour others; counters far fewer than the tags of a part."""
    rng = random.Random(7)
    pairs = {(track, f"t{min(int(rng.paretovariate(0.6)), 200) + 37 * (track % 3) * (rng.random() < 0.5)}") for track in range(90) for _ in range(25)}
    table = spark.createDataFrame([(track, tag, 1) for track, tag in pairs], "track long, tag string, n long").repartition(6)
    want = sorted(Counter(tag for _, tag in pairs).items(), key=lambda c: (-c[1], c[0]))
    got = [(r.tag, r.n_tracks) for r in tags.build_tag_vocab(table, n_tags, min_tracks, counters).orderBy(F.desc("n_tracks"), "tag").collect()]
    assert got == [(tag, n) for tag, n in want if n >= min_tracks][:n_tags]


def test_sketch_misses_no_more_than_it_says(spark):
    rng = random.Random(8)
    rows = [(n, f"t{int(rng.expovariate(0.05))}") for n in range(6000)]
    table = spark.createDataFrame(rows, "track long, tag string").repartition(5)
    counts = Counter(tag for _, tag in rows)
    told = {r.tag: r.n for r in tags.tag_sketch(table, 8).collect()}
    missed = told.pop(None)
    assert missed > 0 and len(told) <= 5 * 16
    assert all(told.get(tag, 0) <= n <= told.get(tag, 0) + missed for tag, n in counts.items())


def test_large_vocabularies_are_joined_with_salt(spark, monkeypatch):
    counted = tags.normalize_tags(raw(spark))
    ids = tags.encode_tag_ids(tags.build_tag_vocab(counted, 2))
    monkeypatch.setattr(tags, "SENT_BYTES", 1)
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(ordering, "MAX_HOT_KEYS", 2)
    assert {tuple(r) for r in tags.bag_of_tags(counted, ids).collect()} == {(1, 1, 2), (2, 1, 1), (3, 0, 2), (3, 1, 1)}
    assert tags.tags_in_vocab(counted, ids).count() == 4
    assert [r.tag for r in tags.tags_out_of_vocab(counted, ids).collect()] == ["jazz"]
    assert tags.normalize_tags(raw(spark)).count() == 5


@pytest.mark.parametrize("code, tag", [(8, 0), (-1, 0), (None, 0), (0, -1), (0, None)])
def test_joint_matrix_keeps_codes_and_tags_apart(spark, code, tag):
    codes = spark.createDataFrame([(1, code, 4)], "track long, code int, n long")
    bags = spark.createDataFrame([(1, tag, 2)], "track long, tag_id int, n long")
    with pytest.raises(Exception, match="out of range"):
        counts.joint_matrix(codes, bags, 8).collect()


@pytest.mark.parametrize("sent, stems", [(64 << 20, 8), (150, 8), (1, 8), (1, 0)])
def test_rare_tags_are_stemmed_in_place_and_frequent_ones_once(spark, monkeypatch, sent, stems):
    """Unless raw tags are many and each on many rows, no table of tracks and raw tags is written or shuffled."""
    monkeypatch.setattr(tags, "SENT_BYTES", sent)
    monkeypatch.setattr(tags, "STEMS", stems)
    written, stage = [], tags.stage
    monkeypatch.setattr(tags, "stage", lambda df, label: written.append((label, df.columns)) or stage(df, label))
    rows = [(t, w) for t in range(6) for w in ["Rocks", "rock", "--", "jazz!"][: t + 1] + [f"Singles{t}", None]] + [(None, "rock")] * 2
    want = Counter((t, w.lower().strip("-!").removesuffix("s") if not w.startswith("S") else f"singles{t}") for t, w in rows if w and w != "--")
    got = tags.normalize_tags(spark.createDataFrame(rows, "track long, raw string")).collect()
    assert Counter({(r.track, r.tag): r.n for r in got}) == want and len(got) == len(want)
    assert any("track" in columns for _, columns in written) == (stems == 0)


def test_frequent_forms_keep_to_the_room(spark, monkeypatch):
    raw_tags = spark.createDataFrame([(n, w) for w, k in [("Cats", 9), ("dogs", 4), ("one", 1)] for n in range(k)], "track long, raw string")
    monkeypatch.setattr(tags, "SENT_BYTES", 60)
    forms, rare = tags.frequent_forms(raw_tags)
    assert [tuple(r) for r in forms.collect()] == [("Cats", "cat")] and rare
    monkeypatch.setattr(tags, "STEMS", 3)
    assert not tags.frequent_forms(raw_tags)[1]


@pytest.mark.parametrize("name", ["build_tag_vocab", "encode_tag_ids"])
def test_vocabulary_queries_count_the_tags_once(spark, monkeypatch, name):
    """Every pass of the vocabulary reads the counted tags as a stored table."""
    read, build = [], tags.build_tag_vocab
    monkeypatch.setattr(tags, "build_tag_vocab", lambda df, *args: read.extend(df.inputFiles()) or build(df, *args))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert read and all("/tags-" in file for file in read)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_arrays_of_raw_tags_are_counted_without_a_shuffle(spark, monkeypatch, block):
    monkeypatch.setattr(tags, "STEMMED", block)
    rows = [(1, ["Rock", "rocks", "", "jazz!", None]), (2, ["rock", "--"]), (3, []), (4, None), (None, ["folk", "Folk", "rock"]), (5, ["Cats"] * 9)]
    rows += [(n, [f"Words{n % 4}", "dog", "dogs"] * (n % 5)) for n in range(10, 60)]
    want = Counter((t, w.lower().strip("-!").removesuffix("s")) for t, ws in rows for w in ws or [] if w and w != "--")
    for parts in (1, 5):
        got = tags.normalize_tags(spark.createDataFrame(rows, "track long, raw array<string>").repartition(parts))
        assert "Exchange hash" not in plan(got)
        got = got.collect()
        assert Counter({(r.track, r.tag): r.n for r in got}) == want and len(got) == len(want)


def test_each_raw_tag_of_a_block_is_stemmed_once(spark):
    rows = [(t, ["rock", "Jazz", "rock"]) for t in range(50)]
    got = tags._tags_in_blocks(spark.createDataFrame(rows, "track long, raw array<string>").coalesce(1)).collect()
    assert sorted((r.block, r.raw, len(r.track), sum(r.n)) for r in got) == [(0, "Jazz", 50, 50), (0, "rock", 50, 100)]


@pytest.mark.parametrize("sent", [64 << 20, 1])
@pytest.mark.parametrize("again", [[], [(2, "rock jazz"), (None, "rock"), (None, "Rocks"), (2, None)]])
def test_only_texts_of_repeated_keys_are_shuffled(spark, monkeypatch, sent, again):
    monkeypatch.setattr(tags, "SENT_BYTES", sent)
    taken, normalize = [], tags.normalize_tags
    monkeypatch.setattr(tags, "normalize_tags", lambda raw: taken.append({r.track for r in raw.collect()}) or normalize(raw))
    texts = [(1, "Rock rocks\njazz! 7"), (2, " rock --"), (3, ""), (4, None), (None, "folk"), *again]
    got = tags.tags_of_texts(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id")
    want = Counter((t, w.lower().strip("-!").removesuffix("s")) for t, text in texts for w in (text or "").split() if w != "--")
    rows = got.collect()
    assert Counter({(r.track, r.tag): r.n for r in rows}) == want and len(rows) == len(want)
    assert ("Exchange hash" in plan(got)) == bool(again)
    # of keys that are few enough to be sent, the words of the others stay where they are
    if again and sent > 1:
        assert taken == [{1, 3, 4}, {2, None}]


def test_candidates_of_a_vocabulary_are_broadcast(spark):
    """The table of all counters is too large for that by its size, its few candidates are not."""
    rows = [(n, f"t{n % 3 if n % 2 else n}") for n in range(600)]
    table = spark.createDataFrame(rows, "track long, tag string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        vocab = tags.build_tag_vocab(table, 3, counters=20)
        assert "BroadcastHashJoin" in plan(vocab) and "SortMergeJoin" not in plan(vocab)
        assert [r.n_tracks for r in vocab.collect()] == [101, 101, 100]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_unchanged_words_are_what_the_steps_leave_alone(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeiouybdglnst7xkwo", k=rng.randint(1, 9))) + rng.choice("0abfhjkopqvwxz") for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "raw string")
    assert df.where(F.col("raw").rlike(stem.UNCHANGED)).count() == len(words)
    assert [r.s for r in df.select(stem.stem_words(F.array("raw"))[0].alias("s")).collect()] == words
    assert not any(re.search(stem.UNCHANGED, w) for w, s in STEMS.items() if w != s)


def test_words_that_end_as_no_step_asks_for_are_unchanged(spark):
    """Not only by their last letter, and of any letters."""
    words = ["rhythm", "balkan", "garten", "ñandu", "éclair", "guitar", "abend", "mit", "boxen"]
    df = spark.createDataFrame([(w,) for w in words], "raw string")
    assert [r.u for r in df.select(F.col("raw").rlike(stem.UNCHANGED).alias("u")).collect()] == [True] * len(words)
    assert [r.s for r in df.select(stem.stem_words(F.array("raw"))[0].alias("s")).collect()] == words


def test_separators_at_the_ends_of_a_tag(spark):
    rows = {"Cats,": "cat", "--cats": "cat", "rock\n": "rock", "\nbox\n": "box", "A-Ha!": "aha", "": "", " ": "", "Äpfel...": "äpfel", None: None}
    df = spark.createDataFrame([(w,) for w in rows], "raw string")
    assert {r.raw: r.tag for r in df.select("raw", tags.normalize_tag(F.col("raw")).alias("tag")).collect()} == rows


@pytest.mark.parametrize("again", [[], [("a", "rock jazz"), (None, "Rocks")]])
def test_words_of_texts_are_those_of_the_split(spark, again):
    """Whatever white space: of the given kinds it separates words, other kinds belong to them."""
    texts = [("a", "Rock\x0bJazz rock"), ("b", "\tfolk\r\ndisco\x0c"), ("c", "rock\u00a0pop \x1crock  "), ("d", ""), ("e", None), (None, " x")]
    for some in (texts + again, [(k, t and t.replace("\x0b", " ")) for k, t in texts + again]):
        df = spark.createDataFrame(some, "doc_id string, text string").coalesce(1)
        want = tags.normalize_tags(tags.words_of(df, "doc_id")).collect()
        got = tags.tags_of_texts(df, "doc_id").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) > 6


def listed_and_not(spark):
    texts = [(n, " ".join(["rock"] * (n % 3 + 1) + ["Jazz", f"w{n % 7}k"])) for n in range(40)] + [(3, "rock folk"), (None, "jazz"), (None, "jazz rock")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    return tags.list_tags_of_texts(df, "doc_id"), tags.tags_of_texts(df, "doc_id")


@pytest.mark.parametrize("most", [1, 3, 1 << 10])
def test_listed_tags_are_the_counted_ones(spark, monkeypatch, most):
    monkeypatch.setattr(tags, "LISTED", most)
    listed, counted = listed_and_not(spark)
    rows = listed.collect()
    assert all(r.n_tracks == len(r.tracks) <= most for r in rows)
    got = [(p.track, r.tag, p.n) for r in rows for p in r.tracks]
    assert Counter(got) == Counter(map(tuple, counted.collect()))


def test_tags_of_a_block_are_one_row(spark):
    """Not one for each track: 90 pairs of track and tag, three rows."""
    df = spark.createDataFrame([(n, "rock Rocks jazz folk") for n in range(30)], "doc_id long, text string").coalesce(1)
    listed = tags.list_tags(tags.whole_texts(df, "doc_id"))
    assert sorted((r.tag, r.n_tracks) for r in listed.collect()) == [("folk", 30), ("jazz", 30), ("rock", 30)]


@pytest.mark.parametrize("sent", [64 << 20, 1])
def test_listed_tags_meet_a_vocabulary_like_counted_ones(spark, monkeypatch, sent):
    listed, counted = listed_and_not(spark)
    for counters in (1, 1 << 16):
        first, second = (tags.build_tag_vocab(some, 3, counters=counters).collect() for some in (listed, counted))
        assert [tuple(r) for r in first] == [tuple(r) for r in second] and [r.tag for r in first][:2] == ["jazz", "rock"]
    ids = tags.encode_tag_ids(tags.build_tag_vocab(listed, 3))
    monkeypatch.setattr(tags, "SENT_BYTES", sent)
    for operator in (tags.bag_of_tags, tags.tags_in_vocab, tags.tags_out_of_vocab):
        first, second = operator(listed, ids), operator(counted, ids)
        names = ["track", *[c for c in second.columns if c != "track"]]
        assert sorted(first.columns) == sorted(second.columns)
        assert Counter(map(tuple, first.select(names).collect())) == Counter(map(tuple, second.select(names).collect())) != Counter()
