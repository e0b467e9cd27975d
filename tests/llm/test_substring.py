"""What line hashing lists and removes, on small cases."""

import random
import re
from collections import Counter

from marlstone.llm import substring

DOCS = "doc_id long, text string"


def texts(spark, rows):
    return Counter((r.doc_id, r.text) for r in substring.dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect())


def test_short_whole_lines_go(spark):
    rows = [(1, "first here\nSubscribe to  our newsletter\n今日は良い天気です。"), (2, "subscribe to our newsletter\nsecond here"), (3, "third here\n今日は良い天気です。\nlast"), (4, "Third  here")]
    assert texts(spark, rows) == Counter([(1, rows[0][1]), (2, "\nsecond here"), (3, "third here\n\nlast")])
    found = {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id, r.first_word) for r in substring.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(2, 0, 27, 4, 1, 2), (3, 11, 21, 1, 1, 6), (4, 0, 11, 2, 3, 0)}


def test_passages_without_sentence_ends_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows, passages = [], []
    for k in range(150):
        passage = [word() for _ in range(52)]
        passages.append(set(passage))
        rows += [(2 * k + j, " ".join([*(word() for _ in range(rng.randint(5, 40))), *passage, *(word() for _ in range(rng.randint(5, 40)))])) for j in range(2)]
    left = dict(texts(spark, rows).keys())
    gone = [52 - len(passages[i // 2] & set(left[i].split())) for i, _ in rows]
    assert not any(gone[::2]) and min(gone[1::2]) >= substring.MIN_RUN and sum(gone[1::2]) > 0.7 * 52 * 150
    for i, t in rows:
        assert set(t.split()) - set(left[i].split()) <= passages[i // 2]


def test_lines_between_repeats_stay(spark):
    head, foot = "a header of ten words that stands on every page", "and a footer of eleven words that stands there as well"
    body = "roses\nare red\n7 8 9\n漢字\nviolets"
    rows = [(1, f"{head}\nelse\n{foot}"), (2, f"{head}\n{body}\n{foot}")]
    assert texts(spark, rows) == Counter([(1, rows[0][1]), (2, f"\n{body}\n")])
    found = substring.repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.start, r.end, r.n_words) for r in found) == [(0, len(head), 10), (len(rows[1][1]) - len(foot), len(rows[1][1]), 11)]


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    line = "the line that all of these rows have in common"
    rows = [(7, f"{line}\nseven a"), (7, f"{line}\nseven b"), (None, f"{line}\nnone a"), (None, f"{line}\nnone b"), (None, "clean text that is long enough to be cut by mistake, and has no copy"), (9, None)]
    left = texts(spark, rows)
    assert Counter(i for i, _ in left.elements()) == {7: 2, None: 3, 9: 1}
    assert sum(line in (t or "") for _, t in left.elements()) == 1 == sum(line in t for i, t in left if i == 7)
    assert {re.sub(f"^{line}|\n", "", t) for _, t in left if t} == {"seven a", "seven b", "none a", "none b", rows[4][1]}
    assert Counter(r.doc_id for r in substring.repeats(spark.createDataFrame(rows, DOCS)).collect()) == {7: 1, None: 2}
