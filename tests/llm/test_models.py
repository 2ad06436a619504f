"""Decontamination, line dedup, chats, classifiers and the pipeline against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import conversations, decontaminate, language_id, line_dedup, quality_knn
from weftline.llm.common import table


def distance(p: str, t: str) -> int:
    """Fewest edits from p to any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


# operator 3


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(7))
    items = [(i, "".join(word() for _ in range(rnd.randint(8, 20)))) for i in range(8)] + [(8, "tiny"), (9, None), (10, "")]
    docs = []
    for d in range(60):
        item = list(decontaminate.normal(items[d % 8][1]))
        for _ in range(rnd.randint(0, len(item) // 7)):
            at = rnd.randrange(len(item))
            item[at : at + rnd.randint(0, 1)] = rnd.choice(["z", "", "y"])
        docs.append((d, " ".join([word(), "".join(item).upper() if d % 3 else "".join(item), word() * 9])))
    docs += [(100, None), (101, ""), (102, "a tiny thing"), (103, "destiny"), (None, items[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id long")
    rows = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, t in docs:
        for i, x in items[:8]:
            p, n = decontaminate.normal(x), decontaminate.normal(t or "")
            k = distance(p, n) if n else 99
            if k <= decontaminate.edits_allowed(len(p)):
                want[d, i] = k
    want[102, 8] = 0
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == want and len(want) > 20
    for r in rows:
        n = decontaminate.normal(dict(docs)[r.doc_id])
        assert distance(decontaminate.normal(dict(items)[r.item_id]), n[r.start : r.end]) == r.edits


def test_items_in_blocks(spark, sf_dir, monkeypatch):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = {tuple(r) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2_000)
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == one and one
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({r[0] for r in one})


# operator 5


@pytest.fixture(scope="module")
def lined(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 11)))
    line = lambda n: " ".join(word() for _ in range(n))
    long = [word() for _ in range(24)]
    rows = []
    for d in range(60):
        lines = [line(rnd.randint(5, 14)) for _ in range(4)]
        if d % 3 == 0:
            lines.insert(2, f"Page {d} of the yearly report")
        if d % 3 == 1:
            x = list(long)
            x[9] = word()
            lines.append(" ".join(x))
        rows.append((d, "\n".join(lines)))
    copy = [line(9) for _ in range(5)]
    rows += [(100 + i, "\n".join([*copy[:4], line(9) if i % 2 else copy[4]])) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "two words"), (None, rows[0][1]), (0, rows[0][1])]
    return rows


def slow_line_dedup(rows: list[str | None]) -> list[str | None]:
    """The rule said again, with sets in place of joins and shingles in place of sketches."""
    texts = sorted({t for t in rows if t})

    def shingles(t: str) -> set:
        words = t.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, part = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and part[i] != part[j] and 2 * len(x & sets[j]) >= len(x | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]

    def tokens(line: str) -> tuple:
        return tuple("<*>" if any(c in "0123456789" for c in x) else x for x in line.split())

    enough = lambda line: 3 if len(line) >= 8 else 10
    stands: dict = defaultdict(set)
    for t, c in zip(texts, part, strict=True):
        for x in t.split("\n"):
            stands[tokens(x)].add(c)
    lines = [x for x in stands if len(x) >= 3]
    allowed = lambda x: min(3, len(x) // 4)

    def parts(x: tuple) -> list[tuple]:
        k = allowed(x) + 1
        cuts = [2 + (len(x) - 2) * i // k for i in range(k + 1)]
        return [(len(x), x[:2], i, x[cuts[i] : cuts[i + 1]]) for i in range(k)]

    leaves, common, words, templates = (defaultdict(set) for _ in range(4))
    for x in lines:
        leaves[len(x), x[:2]] |= stands[x]
        for p in parts(x):
            common[p] |= stands[x]
    lines = [x for x in lines if len(leaves[len(x), x[:2]]) >= enough(x) and any(len(common[p]) >= enough(x) for p in parts(x))]
    for x in lines:
        for i, w in enumerate(x[2:], 2):
            words[len(x), x[:2], i, w] |= stands[x]

    def template(x: tuple) -> tuple | None:
        made = x[:2] + tuple(w if len(words[len(x), x[:2], i, w]) >= enough(x) else None for i, w in enumerate(x[2:], 2))
        learnt = made.count(None)
        return made if learnt <= allowed(x) and 2 * (learnt + sum(w == "<*>" for w in x)) <= len(x) else None

    for x in lines:
        templates[template(x)] |= stands[x]

    looked = set(lines)

    def drops(line: str) -> bool:
        made = template(tokens(line)) if tokens(line) in looked else None
        return made is not None and len(templates[made]) >= (10 if None in made or len(made) < 8 else 3)

    return [t and "\n".join(x for x in t.split("\n") if not drops(x)) for t in rows]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup(spark, lined, limit):
    docs = spark.createDataFrame([(d, t, 5) for d, t in lined], "doc_id long, text string, n_lines int")
    rows = line_dedup.dropped_lines(docs, broadcast_limit=limit).collect()
    want = slow_line_dedup([t for _, t in lined])
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, w) for (d, _), w in zip(lined, want, strict=True))
    dropped = {r.doc_id: r.n_dropped for r in rows if r.doc_id is not None}
    assert all(dropped[d] == (d % 3 != 2) for d in range(1, 60))  # a digit field, and a learnt one
    assert not any(dropped[100 + i] for i in range(40))  # copies of one document are no template


def test_lines_equal_brute_force_on_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.text for r in line_dedup.dropped_lines(table(spark, sf_dir, "documents")).collect()}
    assert got == {r.doc_id: t for r, t in zip(rows, slow_line_dedup([r.text for r in rows]), strict=True)}


def dropped(spark, rows: list[str]) -> list[int]:
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.n_dropped for r in line_dedup.dropped_lines(df).collect()}
    return [found[i] for i in range(len(rows))]


def bodies(rnd, n: int, words: int = 60) -> list[str]:
    """Different texts of few words that are the longest of all, so that longest tokens are few."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    return ["\n".join(" ".join(word() for _ in range(words // 4)) for _ in range(3)) + f"\n{'x' * 20}{'abcdefghijkl'[i % 12]} {word()} {word()} {word()}" for i in range(n)]


def probes(rnd) -> dict[str, list[tuple[str, int]]]:
    """Documents with what is to be dropped of them, by what they show."""
    made: dict[str, list[tuple[str, int]]] = {}
    name = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7)).title()
    one, *others = bodies(rnd, 60)
    licence = "this text may be used under the licence"
    rows = [f"{t}\n{licence}" for t in others] + [f"{one}\n{licence}"] * 300 + [f"{one}\n{licence}\nrevised {i} {t[:5]}" for i, t in enumerate(others)]
    made["a line of many documents, one of which is copied often"] = [(t, 1) for t in rows]
    footer = "all of the rights are reserved\nsee https://www.example.org/terms-and-conditions for the terms\nthis page has been made by hand"
    made["lines that recur together and hold the longest token"] = [(f"{t}\n{footer}", 3) for t in bodies(rnd, 30)]
    made["passages"] = []
    for n in (2, 3, 5, 9):  # a long line in 3 different documents or more goes, one in 2 stays
        passage = " ".join("".join(rnd.choice("klmnopqr") for _ in range(6)) for _ in range(55))
        made["passages"] += [(f"{t}\n{passage}", int(n > 2)) for t in bodies(rnd, n, 240)]
    made["a short line in nine documents"] = [(f"{t}\nend of page", 0) for t in bodies(rnd, 9)]
    made["a footer with a long address"] = [(f"{t}\nAll rights of this work belong elsewhere\nmore at https://www.example.org/{'long/' * 30}", 2) for t in bodies(rnd, 200)]
    # equal texts are one document, which near-duplicate removal deals with
    made["equal documents of one line"] = [("the only line of all these equal documents is this", 0)] * 500
    made["a line of documents that are copied five times"] = [(f"{t}\nsubscribe to our letter", 1) for t in bodies(rnd, 300)] * 5
    texts = bodies(rnd, 324)
    made["a name in a short line"] = [(f"{t}\nPosted by {name()} on a sunny day", 1) for t in texts[:300]]
    made["a name in a short line of nine documents"] = [(f"{t}\nWritten for {name()} in the last week", 0) for t in texts[300:309]]
    made["as many names as words"] = [(f"{t}\nWhen all {name()} {name()} {name()} came home", 0) for t in texts[309:]]
    made["columns of numbers"] = [(f"{t}\n{i} {i * 7} {i + 3} 12.5", 0) for i, t in enumerate(bodies(rnd, 40))]
    return made


def test_lines_that_go_and_stay(spark):
    made = probes(random.Random(11))
    rows = [(t, n, what) for what, own in made.items() for t, n in own]
    got = dropped(spark, [t for t, _, _ in rows])
    assert {what: sum(g != n for g, (_, n, w) in zip(got, rows, strict=True) if w == what) for what in made} == dict.fromkeys(made, 0)


# operator 8


def test_render_and_parse_are_inverse():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.lists(st.sampled_from(["\\", "#", "<", "</turn>", ":", " ", "\n", "### ", "é", "user", " </turn>\n"]), max_size=8).map("".join)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(piece, piece), max_size=5))
    def check(turns):
        text, mask = conversations.render(turns, "user")
        assert conversations.parse(text) == turns
        assert [conversations.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)] == [t for r, t in turns if r == "user"]

    check()


def test_events_fold(spark):
    log = [
        (1, 1, "message", "a", "user", "hi"), (1, 2, "delta", "b", "assistant", "he"), (1, 3, "delta", "b", "assistant", "llo"), (1, 4, "message", "c", "user", "no"),
        (1, 5, "regenerate", "b", None, None), (1, 6, "delta", "b", "assistant", "bye"), (1, 7, "edit", "a", None, "hi #2"), (1, 8, "edit", "zz", None, "?"), (1, 9, "odd", "a", None, "?"),
        (None, 1, "message", "a", None, None), (2, 1, "message", "a", "user", "x"), (2, 2, "delete", "a", None, None),
    ]
    rnd = random.Random(2)
    rnd.shuffle(log)
    got = {r.conv_id: r for r in conversations.formatted(spark.createDataFrame(log, conversations.EVENT).repartition(3)).collect()}
    assert conversations.parse(got[1].formatted) == [("user", "hi #2"), ("assistant", "bye")]
    assert conversations.parse(got[None].formatted) == [("", "")] and got[2].formatted == "" and got[2].n_turns == 0
    assert conversations.formatted(spark.createDataFrame([], conversations.EVENT)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_rows_of_one_turn(spark, parts):
    """Equal turns come in the order of role and text, equal rows as often as they stand there."""
    rnd = random.Random(parts)
    rows = [(1, 3, r, t) for r in ("user", "assistant", None) for t in ("b", "a", "a", None)] + [(1, 2, "user", "first"), (1, None, "user", "none")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(parts)
    one = conversations.formatted(conversations.as_events(df)).first()
    want = sorted(((-1 if t is None else t, r or "", x or "") for _, t, r, x in rows))
    assert conversations.parse(one.formatted) == [(r, x) for _, r, x in want]


def test_chat_query(spark, sf_dir):
    rows = {r.conv_id: r for r in conversations.op8_chat_formatting(spark, sf_dir).collect()}
    turns = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert rows.keys() == turns.keys()
    for c, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in t)
        assert (rows[c].n_turns, rows[c].turns_sha256, rows[c].loss_chars, rows[c].loss_sha256) == (len(t), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# operators 4 and 9


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = quality_knn.op4_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = language_id.op9_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97


def test_classifier_edges(spark, docs, texts, nothing):
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(texts)
    assert all((r.lang_pred == "und") == (not language_id.LETTER.search(dict(texts)[r.doc_id] or "")) for r in rows if r.doc_id is not None)
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(nothing)).collect()} == {"und"}
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    rows = quality_knn.scored(docs, quality_knn.fit(docs, labels)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (100, 101, 102)} == {0.5}
    assert {r.score for r in quality_knn.scored(docs, quality_knn.fit(docs, labels.where("false"))).collect()} == {0.0}
    assert quality_knn.scored(nothing, quality_knn.fit(nothing, labels)).count() == 0


def test_votes_equal_brute_force():
    """Ties at the edge go to the first voter, whatever the batch."""
    rng = np.random.default_rng(4)
    idf = np.ones(quality_knn.DIMENSIONS, np.float32)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(120)]
    basis = np.linalg.qr(rng.standard_normal((quality_knn.DIMENSIONS, 6)))[0]
    z = quality_knn.weighted(texts[:60], idf) @ basis
    voters = quality_knn.Voters(idf, basis, z / np.linalg.norm(z, axis=1, keepdims=True), rng.integers(0, 2, 60).astype(float), 7)
    got = voters.scores(texts)
    assert all(voters.scores([t])[0] == g for t, g in zip(texts, got, strict=True))
    tied = 0
    for t, g in zip(texts, got, strict=True):
        near = [round(float(x), 6) for x in voters.place([t])[0] @ voters.latent.T]
        order = sorted(range(60), key=lambda i: (-near[i], i))
        tied += near[order[6]] == near[order[7]]
        weight = [max(near[i], 0) ** 4 for i in order[:7]]
        assert abs(g - sum(w * voters.labels[i] for w, i in zip(weight, order, strict=False)) / sum(weight)) < 1e-8
    assert tied > 10


def test_labels_that_contradict_one_another(spark, docs):
    labels = [(0, 1), (1, 0), (2, 1), (3, 0), (2, 0)]
    first, again = (quality_knn.fit(docs, spark.createDataFrame(x, "doc_id long, quality int").repartition(n)) for x, n in ((labels, 3), (labels[::-1], 2)))
    assert first.labels.tolist() == again.labels.tolist() == [1, 0, 0, 0]


def test_nearest_centroid_equals_brute_force(docs, texts):
    model = language_id.fit(docs, centroids=3)
    for t, (lang, score, far) in zip((t for _, t in texts), model.predict([t for _, t in texts]), strict=True):
        if lang != "und":
            near = [float(language_id.vectors([t], model.idf)[0] @ c) for c in model.centroids]
            j = max(range(len(near)), key=lambda i: (near[i], -i))
            assert lang == model.langs[j] and abs(score - min(1, max(0, near[j]))) < 1e-5 and (abs(near[j] - model.floor[j]) < 1e-5 or far == (near[j] < model.floor[j]))


def test_scripts_with_combining_marks(spark):
    """Vowel signs and tone marks are parts of their words."""
    thai, hindi = "ผู้คนที่นี่ดี", "हिन्दी में लिखा"
    assert language_id.OTHER.sub(" ", thai + " 12_x") == thai + " x" and language_id.OTHER.sub(" ", hindi) == hindi
    rows = [(i, " ".join([t] * (i % 5 + 1)), lang) for i, (t, lang) in enumerate([(thai, "th"), (hindi, "hi"), ("the words of it", "en")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language_id.identify(df, language_id.fit(df.where("doc_id % 2 = 0"))).collect())


def test_more_languages_than_are_learnt(spark, docs, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(i, f"text number {i}", f"l{min(i % 9, 4)}") for i in range(90)]
    assert sorted(set(language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs)) == ["l0", "l4"]


# pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"n_words": F.lit("mine"), "fail_bits": F.lit(1)})
    columns = docs.columns
    counts = [docs.count()]
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, sf_dir)
        assert docs.columns == columns and {r[0] for r in docs.select("n_words").distinct().collect()} <= {"mine"}
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.select("doc_id").distinct().count() == counts[-1]
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_pipeline_of_edges(spark, docs, nothing, sf_dir):
    for rows in (docs, nothing):
        out = rows
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, out, sf_dir)
        assert out.count() >= 0
