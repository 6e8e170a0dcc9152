from quillmark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted(chat.conversations(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position or 0, r.turn or 0))


def test_quotations_are_linked_ordered_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIn Python."),
        (1, 1, "assistant", "Use sorted.\n\nIt returns a new list."),
        (1, 2, "user", "Something else: what is a set?"),
        (1, 3, "user", "Anna wrote:\n> Use SORTED.\n> > How do I  sort a list?\nThanks, and in place?"),
        (1, 4, "assistant", "> Something else: what\n> is a set?\nA collection."),
        (1, 5, "user", ">> never said before\nfine"),
        (1, 6, "assistant", ">Thanks, and in place?\nlist.sort"),
    ]
    found = run(spark, rows)
    assert [r.turn for r in found] == [0, 1, 3, 6, 2, 4, 5]
    assert {r.turn: r.parent_turn for r in found} == {0: None, 1: None, 2: None, 3: 1, 4: 2, 5: None, 6: 3}
    assert {r.turn: r.depth for r in found} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 2}
    texts = {r.turn: r.text for r in found}
    assert texts[3] == "Thanks, and in place?" and texts[4] == "A collection." and texts[5] == "fine"
    assert texts[0] == rows[0][3]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "a"), (2, None, "user", None), (2, 0, None, None), (2, 1, "user", "> x"), (2, 1, "user", "> x"), (2, 2, "user", "z" * 100_000)]
    found = run(spark, rows)
    assert len(found) == len(rows)
    assert [r.position for r in found if r.turn is not None and r.conv_id == 2] == [0, 1, 1, 3]
    assert all(r.position is None for r in found if r.conv_id is None or r.turn is None)
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_threads_need_few_rounds(spark):
    rows = [(1, 0, "user", "line number 0")] + [(1, t, "user", f"> line number {t - 1}\nline number {t}") for t in range(1, 40)]
    found = run(spark, rows)
    assert [r.depth for r in found] == list(range(40)) and {r.root_turn for r in found} == {0}


def test_equals_its_sql(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(3)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randint(1, 9)):
            own = " ".join(rng.choices(["tea", "Bread", "and", "milk?"], k=rng.randint(1, 4))) + rng.choice(["", "\nmore  lines", "\n\nA paragraph"])
            quoted = ""
            if said and rng.random() < 0.6:
                source = rng.choice(said)
                quoted = rng.choice(["", "Bob wrote:\n"]) + "\n".join(rng.choice(["> ", ">", ">> "]) + x for x in source.split("\n")[: rng.randint(1, 3)]) + "\n"
            rows.append((conv, turn, "user", quoted + own))
            said.append(own)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(map(str, (tuple(r) for r in chat.op7_chat(spark, str(tmp_path)).collect())))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == sorted(map(str, c.execute(chat.ORACLE).fetchall()))
