import random
import re
from collections import Counter

from odd_rows import LONG, ODD, by_row, frame
from tablelore.llm import outliers

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_counts(ident, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (ident, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_counts_of_odd_rows(spark):
    more = [(20, "a b c d e f a b c d e f a b c d e"), (21, "x\nx\n\n \nx y\nx y"), (22, "# * $ % & | < > 1 2"), (23, LONG + LONG)]
    rows = ODD + more
    assert by_row(outliers.text_counts(frame(spark, rows)), *COLUMNS) == sorted((plain_counts(*r) for r in rows), key=repr)


def test_planted_outliers_go_and_clean_texts_stay(spark):
    source = random.Random(5)
    words = [f"{chr(97 + k % 26)}{'xyzuvw'[:k % 6]}{chr(98 + k % 23)}" for k in range(300)]
    rows = []
    for i in range(400):
        text = " ".join(source.choices(words, k=source.randint(40, 200)))
        rows.append((i, re.sub(r"(\S+)", r"\1%%%", text) if i % 5 == 0 else text))
    rows += ODD
    found = {r.doc_id: r for r in outliers.outlying(frame(spark, rows)).collect()}
    assert outliers.outlying(frame(spark, rows)).count() == len(rows)
    assert not any(found[i].kept for i in range(20, 400, 5))
    assert all(found[i].kept for i in range(20, 400) if i % 5)
    assert not found[3].base_failed or not found[3].kept


def test_small_groups_reject_nothing_and_no_rows_give_none(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(5)] + [(9, "%%% ### " * 3 + " ".join(map(str, range(30))))]
    assert all(r.kept for r in outliers.outlying(frame(spark, rows)).collect())
    assert outliers.outlying(frame(spark, [])).count() == 0
