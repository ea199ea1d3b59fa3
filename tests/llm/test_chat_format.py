import random

import duckdb
import pandas as pd

from quakeloom.llm import chat_format as C

ROWS = [
    (1, 0, "u", "Hello there.\nHow are you?"),
    (1, 1, "a", "> How  ARE you?\n\nFine."),
    (1, 2, "u", "> > how are you?\n> Fine.\nGood.\n\nSecond paragraph\nof two lines."),
    (1, 3, "a", ">> Hello there.\n>> How are you?\nBack to the start."),
    (1, 4, "u", "> Second paragraph\n> of two lines.\nnested\n> unknown words\n"),
    (1, 5, "a", "plain"),
    (2, 0, "u", "> Hello there.\nquotes another conversation"),
    (2, 0, "u", "> Hello there.\nquotes another conversation"),
    (2, 7, None, None),
    (3, 5, "u", "ok"),
    (3, 300, "a", "ok"),
    (3, 900, "u", "> ok\nyes"),
    (3, 901, "u", ""),
    (None, 1, "u", "> ok"),
    (4, None, "u", "x > y"),
]


def both(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level", "2 AS hash", "3 AS wrote", "4 AS run")
    got = sorted(map(tuple, C.format_chats(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.register("rows", pd.DataFrame({c: pd.array([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}.items())}))
    con.execute("insert into conversations select * from rows")
    want = sorted(con.execute(f"select conv_id, turn, role, reply_to, branch, n_quotes, n_linked, text from ({C.ORACLE_SQL['op8_chat_formatting']})").fetchall(), key=str)
    return got, want


def test_links(spark):
    got, want = both(spark, ROWS)
    assert got == want
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 2][3:7] == (1, 0, 2, 2) and by[1, 3][3:5] == (0, 3) and by[1, 5][4] == 4 and by[3, 900][3] == 300
    assert by[1, 1][7] == "Fine." and by[1, 4][7] == "nested" and by[2, 7][3] == 0


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_of_parts(spark):
    rows = [
        (1, 0, "u", "First line of a paragraph\nits second line\nand its third.\n\nAnother paragraph.\n\nThe last paragraph."),
        (1, 1, "a", "Unrelated.\nA line of its own."),
        (1, 2, "a", "> its second line\n> and its third.\nTwo lines of a paragraph."),
        (1, 3, "u", "> First line of a paragraph\n> its second line\n> and its third.\n>\n> The last paragraph.\nTwo of three paragraphs."),
        (1, 4, "a", "> > A line of its own.\n> Two of three paragraphs.\nBetween.\n> Unrelated.\nEnd."),
        (1, 5, "u", "> Between.\n> End.\nOwn lines around a quote."),
        (1, 6, "a", "> Unrelated.\n> Another paragraph.\n> The last paragraph.\nMost characters are of the first turn."),
        (1, 7, "a", "> Unrelated, and never written.\nNo link."),
    ]
    got, want = both(spark, rows)
    assert got == want
    assert [r[3] for r in sorted(got, key=lambda r: r[1])] == [None, 0, 0, 0, 3, 4, 0, 6]
    assert [r[6] for r in sorted(got, key=lambda r: r[1])] == [0, 0, 1, 1, 3, 1, 1, 0]


def test_large_generated_table(spark):
    """Nested quotes of wholes, paragraphs and lines, and one conversation that holds most rows and a line in every message."""
    r = random.Random(3)
    rows, said = [], {}
    for conv in range(12):
        for turn in range(1500 if conv == 0 else r.randrange(5, 60)):
            own = ["\n".join(" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))]
            text, quotes = "\n\n".join(own), []
            for level in range(1, r.randrange(1, 5)):
                if turn and r.random() < 0.8:
                    lines = said[conv, r.randrange(max(0, turn - 600), turn)].split("\n")
                    at = r.randrange(len(lines))
                    quotes += [">" * level + " " + x.upper() for x in (lines if r.random() < 0.3 else lines[at : at + r.randrange(1, 4)])]
            said[conv, turn] = text
            parts = [*quotes, text, "me too" if r.random() < 0.7 else "", *([f"> me too\n{'long ' * 40000}"] if turn == 40 else [])]
            rows.append((conv, turn, "u", "\n".join(parts)))
    got, want = both(spark, rows)
    assert got == want
    assert sum(x[6] for x in got) > 1000 and sum(x[3] is not None and x[3] != x[1] - 1 for x in got) > 500
