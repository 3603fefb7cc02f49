"""Steps whose work must not grow faster than their input, on small tables of their own."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
import pytest

from lectern.functions import batches
from lectern.functions import money as M
from lectern.operators import chunking, compare, extraction, invoices, labels, library, retrieval, skills, statement
from lectern.plans import compare as compare_plans
from lectern.plans import ingest, statements, tables
from lectern.sources import exports, files
from lectern.streaming import audit

from .conftest import SMALL


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_written_to_a_folder_of_each_kind(spark):
    """one file for each supplier, and no folder for each."""
    folder = ingest.supplier_files(spark, SMALL)
    paths = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect()]
    assert len(paths) == tables.table(spark, SMALL, "supplier").count()
    assert len({p.rpartition("/")[0] for p in paths}) <= 8


def test_letters_are_dealt_out_and_equal_rows_call_a_function_once(spark):
    """a small file of customers isn't one task; a run of equal rows is one call of a user's function."""
    assert statements._personal(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    calls = []
    tool = skills.SqlTool("noted", lambda *row: calls.append(row) or str(row), ("string", "bigint"), "string")
    made = skills._values(tool, pd.Series(["a", "a", "a", None, None, "a"], dtype=object), pd.Series([1, 1, 2, 2, 2, 1]))
    assert calls == [("a", 1), ("a", 2), (None, 2), ("a", 1)]
    assert list(made) == [str(row) for row in (("a", 1), ("a", 1), ("a", 2), (None, 2), (None, 2), ("a", 1))]


def test_classed_lines_are_read_once(spark):
    """a filter on the kind isn't rewritten into what it is made of, no pattern is compiled for each row, and what is unread comes along."""
    text = "EUR\nPart 2 20% 1,00  2,00\nWidget 10 100\nSumme 7,00 x\nHosting ￿ 3,00 5,00\nper 1.2.2020 Netto 7,00 MwSt 20% 1,40 Brutto 8,40"
    documents = spark.createDataFrame([(1, text), (2, "no figure"), (3, None)], "doc_id long, text string")
    rows = invoices.classed(documents)
    plan = plan_of(rows.where("kind = 'item'"))
    assert plan.count("regexp_extract_all") == plan_of(rows).count("regexp_extract_all")
    found = {r.description: (r.doc_id, r.cents, r.dropped) for r in invoices.items(rows, unread=True).collect()}
    joined = {r.description: (r.doc_id, r.cents, r.dropped) for r in invoices.items(rows).join(invoices.unread(rows), "doc_id").collect()}
    assert found == joined and len(found) >= 2


def test_currency_by_windows_is_that_of_the_vote(spark):
    documents = spark.createDataFrame([(1, "1,00 EUR\n2,00 USD\n3,00 USD"), (2, "1,00 USD\n2,00 EUR"), (3, "none"), (None, "5,00 CHF")], "doc_id long, text string")
    rows = statement.with_currency(statement.lines(documents))
    assert {(r.doc_id, r.doc_currency) for r in rows.collect()} == {(1, "USD"), (2, "USD"), (3, None), (None, "CHF")}
    assert spark.range(1).select(M.once(M.F.lit("a"), lambda x: M.F.concat(x, x)).alias("x")).first().x == "aa"


def test_scopes_are_counted_without_a_row_for_each_document(spark):
    """counts equal those of the scopes written out, with sets that overlap, repeated rows, unknown collections and attachments."""
    scopes = [(1, '{"collectionIds":["a","b","a"],"documentIds":[1,9]}', None, None), (2, "{broken", "[5,6,5]", None), (3, None, None, "b"), (4, None, "[]", None), (5, '{"collectionIds":["none"]}', None, None), (6, None, None, "a"), (6, None, None, "b"), (7, '{"documentIds":[2,null]}', None, None), (8, None, None, "a"), (None, None, None, "a"), (8, None, "[1,7]", None)]
    conversations = spark.createDataFrame(scopes, "conv_id long, scope_json string, ids_json string, project string")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "Library"), (None, "b")], "doc_id long, collection string")
    attached = spark.createDataFrame([(1, 3), (3, 8), (4, 4), (9, 1)], "conv_id long, doc_id long")
    whole = library.resolved_scope(conversations, members, attached).groupBy("conv_id").agg(M.F.count("*").alias("documents"), M.F.min("doc_id").alias("first"))
    counted = library.scope_sizes(conversations, members, attached)
    key = lambda r: (r.conv_id is None, r.conv_id or 0, r.documents, r.first)
    assert sorted(map(key, counted.collect()), key=str) == sorted(map(key, whole.collect()), key=str)


def test_header_lines_are_found_before_they_are_read(spark):
    """lines without a label or a date are left out first; the order of day and month still comes from all dates."""
    text = "Vendor: A & B\nInvoice date 02.03.2021\nItem  1,00  2,00\nsent 12/31/2020\ndate 1,00\nBill to: number 7\nCustomer: C"
    rows = {r.doc_id: r for r in statement.invoice_header(spark.createDataFrame([(1, text), (2, "Item 1,00"), (3, "due 31.12.2020")], "doc_id long, text string")).collect()}
    assert (rows[1].vendor, rows[1].recipient, str(rows[1].date), rows[1].due_date) == ("A & B", "C", "2021-02-03", None)
    assert str(rows[3].due_date) == "2020-12-31" and rows[3].vendor is None


def test_batches_of_a_function_go_back_as_one_table(spark):
    """45 rows are three batches of a function and one table of Arrow; a batch that fails keeps what it has."""
    rows = spark.createDataFrame([(i, f"d{i}", i) for i in range(45)], "pos long, description string, cents long").coalesce(1)

    def choose(batch):
        if batch[0] == "d20":
            raise KeyError
        return ["Rent" if d != "d1" else "Other" for d in batch]

    made = labels.categorised(rows, ["Rent"], choose, failed="why")
    sizes = made.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long").collect()
    assert [r.n for r in sizes] == [45]
    found = sorted(made.collect(), key=lambda r: r.pos)
    assert [r.category for r in found] == ["Rent", "Uncategorized", *["Rent"] * 18, *["Uncategorized"] * 20, *["Rent"] * 5]
    assert [r.why for r in found] == [*[None] * 20, *["KeyError"] * 20, *[None] * 5]


@pytest.fixture
def kernels(monkeypatch):
    """The functions that a query gives to Spark for its Arrow batches."""
    from pyspark.sql.classic.dataframe import DataFrame

    found, whole = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *more, **named: found.append(run) or whole(self, run, *more, **named))
    return found


def repeated(frame, times: int) -> pa.RecordBatch:
    """The rows of a frame many times, as one batch."""
    return pa.concat_tables([frame.toArrow()] * times).combine_chunks().to_batches()[0]


def test_differences_are_made_in_parts_of_a_batch(spark, kernels):
    """what Python holds follows the part, not the batch; the parts together are the batch."""
    pairs = spark.createDataFrame([("1", "a b " * 5000, "a c " * 5000), ("2", None, "x")], "pair_id string, old string, new string")
    compare.word_diff(pairs)
    made = list(kernels[-1](iter([repeated(pairs, 400)])))
    assert len(made) > 4 and max(m.num_rows for m in made) < 100 and [x for m in made for x in m.column("pair_id").to_pylist()] == ["1", "2"] * 400
    chunks = spark.createDataFrame([(1, 1, 0, "a b " * 5000), (2, 2, 0, "a b " * 5000 + "c")], "doc_id int, chunk_id int, chunk_index int, text string")
    compare.difference_read(spark.createDataFrame([(7, 1, 2)], "pair_id int, a int, b int"), chunks, 5000)
    text = {"a": "a b " * 5000, "b": "a b " * 4990 + "c"}
    rows = spark.createDataFrame([(7, 1, 2, text["a"], 1, 1, text["b"], 1, 2)], "pair_id int, a int, b int, a_text string, a_chunks long, a_head int, b_text string, b_chunks long, b_head int")
    made = list(kernels[-1](iter([repeated(rows, 200)])))
    assert len(made) > 4 and sum(m.num_rows for m in made) == 200 and set(made[0].column("added").to_pylist()) == {1}


def test_parts_of_a_batch():
    batch = pa.record_batch([pa.array(["aa", None, "b" * 50, "c", "dd"]), pa.array(["", "x", None, "yy", "z"])], ["s", "t"])
    cut = [p.column("s").to_pylist() for p in batches.parts(iter([batch, batch.slice(0, 0), batch.slice(3)]), "s", "t", most=6)]
    assert cut == [["aa", None], ["b" * 50], ["c", "dd"], ["c", "dd"]]


def test_chunks_are_cut_in_parts_of_a_batch(spark, kernels):
    """chunks of a batch leave in parts, in order."""
    documents = spark.createDataFrame([(1, "a b " * 5000), (2, None), (3, "c")], "doc_id long, text string")
    for cut in (chunking.chunks, chunking.simple_chunks):
        expected = cut(documents).orderBy("doc_id", "chunk_index").toArrow().to_pylist()
        made = list(kernels[-1](iter([repeated(documents, 400)])))
        assert len(made) > 4 and max(m.nbytes for m in made) < 3_000_000
        assert [row for m in made for row in m.to_pylist()] == expected * 400


def test_changes_meet_windows_that_are_counted_from_the_words(spark):
    """the texts of a pair are built for the difference alone, not once more for their number of words."""
    plan = plan_of(compare_plans.change_chunks(spark, SMALL))
    assert plan.count("array_join(") == 2


def test_terms_are_counted_where_they_stand_and_dealt_once(spark):
    """one exchange from texts to postings; rows that share an id count together."""
    chunks = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, None), (3, "..."), (None, "b B"), (4, "x " * 3000)], "chunk_id long, text string").coalesce(1)
    made = retrieval.Index.postings(chunks, 4)
    assert sorted(((r.chunk_id or 0, r.term, r.tf) for r in made.collect())) == [(0, "b", 2), (1, "a", 3), (1, "b", 1), (1, "c", 1), (4, "x", 3000)]
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_lines_of_an_invoice_are_grouped_once(spark):
    """the three texts of a line go through one grouping."""
    assert plan_of(ingest.invoice_exports(spark, SMALL)).count("collect_list(") == 1
    values = spark.createDataFrame([('a"\n\\ü\t',), ("",), (None,)], "v string").select(exports._string(M.F.col("v")).alias("s"))
    assert [r.s for r in values.collect()] == ['"a\\"\\n\\\\ü\\t"', '""', "null"]
    money = spark.createDataFrame([(-5,), (0,), (123456,), (-100,), (None,)], "v long").select(exports.two_places(M.F.col("v")).alias("s"))
    assert [r.s for r in money.collect()] == ["-0.05", "0.00", "1234.56", "-1.00", None]


def test_figures_of_a_statement_are_searched_once(spark):
    """one search for the figures of a line, no formatter for its dates; lines whose rest touches the date, breaks or tabs are read as before."""
    text = "Opening balance 0,00 CHF\n01.02.2024 02.02.2024 Shop  -4,50  95,50\n words\n03.02.:Bar USD 7,00\n\t13/02/24\tTab\t(1.000,00)\n01.02.20245 x 3,00\n05.02.2024 A 1,00 \r 2,00 EUR\nneuer Saldo 9,00\n06.02.2024 €5,00"
    documents = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = statement.transactions(documents)
    plan = plan_of(rows)
    assert plan.count(M.FIGURE[:20]) <= 4 and not any(x in plan for x in ("format_string", "gettimestamp"))
    found = [(str(r.date), r.value_date and str(r.value_date), r.description, r.cents, r.balance, r.currency) for r in rows.orderBy("pos").collect()]
    assert found == [
        ("2024-02-01", "2024-02-02", "Shop words", -450, 9550, "EUR"), ("2024-02-03", None, ":Bar", 700, None, "USD"), ("2024-02-13", None, "\tTab\t", -100000, None, "EUR"),
        ("2024-02-01", None, "5 x", 300, None, "EUR"), ("2024-02-05", None, "A", 100, 200, "EUR"),
    ]


def test_chunks_of_a_run_of_ids_share_a_state_and_files_a_batch(spark, tmp_path):
    """F16: no group for each chunk and no batch for each file; the file that came last still has the last word, and ids beside a null stay whole."""
    large = (1 << 60) + 1
    files = {"b": [(1, i, f"text {i}") for i in range(400)] + [(7, large, "x"), (7, large + 1, "x"), (None, None, "none")], "a": [(1, 5, "changed"), (1, 6, "text 6")]}
    for at, (name, rows) in enumerate(files.items()):
        spark.createDataFrame(rows, "doc_id long, chunk_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "in" / f"{name}.parquet")
        os.utime(tmp_path / "in" / f"{name}.parquet", (1_700_000_000 + at,) * 2)
    out = str(tmp_path / "out")
    for _ in range(2):
        audit.extracted(audit.table_stream(spark, str(tmp_path / "in"), batch_bytes=1 << 20), out, lambda text, attempt: f'[{{"value": "{text}"}}]', "m").awaitTermination()
    assert [p.name for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit()] == ["0"]
    assert spark.read.format("statestore").load(f"{out}/checkpoint").count() == 3
    records = spark.read.parquet(f"{out}/records").where("record_type = 'generic'")
    assert records.count() == 404
    found = sorted((r.chunk_id or -1, r.doc_id, r.value) for r in extraction.current(spark.read.parquet(f"{out}/records")).where("record_type = 'generic' AND chunk_id > 0").collect())
    assert len(found) == 401 and found[4] == (5, 1, "changed") and found[5] == (6, 1, "text 6") and found[-2:] == [(large, 7, "x"), (large + 1, 7, "x")]


def test_items_are_read_without_dealing_out_lines(spark):
    """F1 of round 5, invoice_items: texts are brought together once by their document, and lines leave a kernel, not windows over lines."""
    plan = plan_of(statements.invoice_items(spark, SMALL))
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan
    found = {(r.description, r.cents) for r in invoices.items(invoices.classed(spark.createDataFrame([(1, "EUR\nBolt 1234567890123456789012,00\nNut 2,00")], "doc_id long, text string"))).collect()}
    assert found == {("Bolt", None), ("Nut", 200)}  # was an error of the whole job


def test_texts_of_one_document_share_its_currency_whatever_their_size(spark):
    texts = ["Part 2 20% 1,00  2,00\n  goes on\nHosting 3,00 500", "7,00 CHF\nNut 3 Stk 1,00 3,00\nTotal 12,00", None, ""]
    rows = invoices.classed(spark.createDataFrame([(k, t) for k in (1, None) for t in texts] + [(2, "Nut 1,00")], "doc_id long, text string"))
    found = sorted((str(r.doc_id), r.description, r.quantity, r.cents, r.currency, r.dropped) for r in invoices.items(rows, unread=True).collect())
    assert found == sorted((k, *x, "CHF", 2) for k in ("1", "None") for x in (("Part goes on", 2.0, 200), ("Nut", 3.0, 300)))
    assert {r.doc_id: r.dropped for r in invoices.unread(rows).collect()} == {1: 2, None: 2, 2: 1}
    kept = invoices._Kept()
    for t in texts:
        kept.add(t)
    every = frozenset(invoices.KINDS)
    assert list(invoices._document(kept, True, every)) == list(invoices._document(tuple(texts), False, every))
    assert {r.kind for r in invoices.classed(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"), ("item",)).collect()} == {"item"}


def test_totals_are_read_in_the_same_kernel(spark):
    """F2 of round 5, invoice_totals: amounts come out of the kernel, and only lines that totals need leave it."""
    plan = plan_of(statements.invoice_totals(spark, SMALL))
    assert plan.count("MapInArrow") == 1 and "regexp_" not in plan
    rows = invoices.classed(spark.createDataFrame([(1, "Netto 1234567890123456789012,00\nUSt 20 % 2,00\nBrutto 12,00")], "doc_id long, text string"))
    assert {(r.net, r.tax, r.gross, r.rate) for r in invoices.totals(rows).collect()} == {(None, 200, 1200, 20.0)}  # was an error of the whole job


def test_crowded_items_know_what_is_unread_without_windows_over_lines(spark):
    """F3 of round 5, invoice_crowded_items: nothing behind the kernel is dealt out or sorted."""
    plan = plan_of(statements.invoice_crowded_items(spark, SMALL))
    assert "Window" in plan and "Window" not in plan.partition("MapInArrow")[0]


def test_crowded_totals_take_two_kinds_of_lines(spark):
    """F4 of round 5, invoice_crowded_totals: one kernel, and no pattern behind it."""
    plan = plan_of(statements.invoice_crowded_totals(spark, SMALL))
    assert plan.count("MapInArrow") == 1 and "regexp_" not in plan


def test_files_that_wait_are_read_while_others_wait(spark, tmp_path):
    """F5 of round 5, parsed_files: deadlines of one task overlap, and files that use a core come one by one."""
    import os
    import time

    for k in range(16):
        (tmp_path / f"{k}.txt").write_text("slow" if k % 2 else f"one\n{k}")

    def lines(content):
        if content == b"slow":
            time.sleep(60)
        yield from ((None, line) for line in content.decode().split("\n"))

    found = files.listed(spark, [str(tmp_path)]).coalesce(1)
    read = files.parsed(found, {"text": lines}, files.Limits(seconds=1.5))
    read.limit(1).collect()  # workers are started once
    began = time.time()
    rows = read.collect()
    assert time.time() - began < 9  # eight deadlines one behind the other are twelve seconds
    assert sorted((r.status, r.error, len(r.pages)) for r in rows) == [("failed", "timeout", 0)] * 8 + [("parsed", None, 2)] * 8

    def spun(kind, content):
        began, until = time.monotonic(), time.process_time() + 0.15
        while time.process_time() < until:
            pass
        return kind, began, time.monotonic(), os.getpid()

    helpers = files._Helpers(spun)
    made = helpers.parsed([(str(k), b"x") for k in range(6)])
    helpers.close()
    assert [m[0] for m in made] == [str(k) for k in range(6)] and all(a[2] <= b[1] for a, b in zip(made, made[1:]))
    large = files._Helpers(lambda kind, content: (kind, len(content), os.getpid()))
    assert large.parsed([(None, b"x" * (files.HANDED + 1))]) == [(None, files.HANDED + 1, os.getpid())]
    large.close()


def test_a_figure_beside_a_rate_is_read_with_the_rate_hidden(spark):
    """F2 and F4 of round 5: parentheses that end right before a rate belong to their figure; places are those of the pattern."""
    rows = invoices.classed(spark.createDataFrame([(1, "Netto ( 4,50 )7,5 %\nUSt 20 % 12,50")], "doc_id long, text string"))
    assert {(r.net, r.tax, r.rate) for r in invoices.totals(rows).collect()} == {(-450, 1250, 20.0)}
    for text in ("( 4,50 )", "x  -12,50", " 1 234,00-", "a,5,00 +2,00", "(  3,00) 1.234.567"):
        assert invoices._places(text) == [m.span() for m in invoices._FIGURE.finditer(text)]
