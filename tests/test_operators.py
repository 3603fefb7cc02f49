"""Operators that SQL doesn't cover, on small tables of their own."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest

from lectern.functions import money as M
from lectern.functions import text as T
from lectern.operators import analysis, budgets, chunking, compare, edits, extraction, grouping, invoices, library, redaction, retrieval, skills, statement
from lectern.plans import compare as compare_plans
from lectern.plans import search
from lectern.sources import exports, files, snapshots
from lectern.streaming import audit


def test_windows_equal_the_closed_form():
    """With words that cost one, window k holds the words from 420 k on, 500 at most."""
    for n in (0, 1, 499, 500, 501, 920, 921, 1500):
        words = [f"w{i}" for i in range(n)]
        expected = [" ".join(words[k * 420 : k * 420 + 500]) for k in range(1 + max(0, -(-(n - 500) // 420)))] if n else []
        assert [text for text, _ in chunking.windows(" ".join(words))] == expected


def test_windows_cover_every_word():
    r = random.Random(3)
    text = " ".join("x" * r.choice([1, 5, 17, 80]) for _ in range(700))
    found = " ".join(t for t, _ in chunking.windows(text, 50, 10))
    assert set(text.split()) <= set(found.replace(" ", "  ").split())


def apply_script(old, new, script):
    out = []
    for kind, i, j in script:
        if kind == "equal":
            assert old[i] == new[j]
            out.append(old[i])
        elif kind == "insert":
            out.append(new[j])
    return out


@pytest.mark.parametrize("seed", range(20))
def test_edit_script_is_right_and_shortest(seed):
    r = random.Random(seed)
    old, new = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
    script = compare.edit_script(old, new)
    assert apply_script(old, new, script) == new
    common = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    assert sum(kind == "equal" for kind, _, _ in script) == common[-1][-1]


def test_word_diff_of_empty_null_and_equal_texts(spark):
    rows = [("1", None, ""), ("2", "a b c", "a b c"), ("3", "a b c", "a x c"), ("4", "", "new words")]
    got = {r.pair_id: r for r in compare.word_diff(spark.createDataFrame(rows, "pair_id string, old string, new string")).collect()}
    assert (got["1"].equal, got["1"].useful) == (0, True)
    assert (got["2"].equal, got["2"].changes) == (3, [])
    assert [tuple(c) for c in got["3"].changes] == [(1, "b", "x")]
    assert (got["4"].inserted, got["4"].useful) == (2, False)


def test_alignment_is_greedy_by_score(spark):
    rows = [("p", "a1", "b1", 0.9), ("p", "a1", "b2", 0.8), ("p", "a2", "b1", 0.85), ("p", "a2", "b2", 0.6), ("p", "a3", "b3", 0.4)]
    got = {(r.id, r.other) for r in compare.aligned(spark.createDataFrame(rows, "pair_id string, id string, other string, score double")).collect()}
    assert got == {("a1", "b1"), ("a2", "b2")}


def test_alignment_of_many_equal_sections(spark):
    rows = [("p", f"a{i:03}", f"b{j:03}", 1.0) for i in range(100) for j in range(100)]
    got = {(r.id, r.other) for r in compare.aligned(spark.createDataFrame(rows, "pair_id string, id string, other string, score double")).collect()}
    assert got == {(f"a{i:03}", f"b{i:03}") for i in range(100)}


def test_redaction_masks_each_kind_once_and_is_idempotent():
    text = "mail a.b@example.org see https://example.org/x IBAN DE89 3704 0044 0532 0130 00 card 4111 1111 1111 1111 on 2024-05-06 call +49 30 1234567"
    masked, counts = redaction.redact(text)
    assert counts == {k: 1 for k in redaction.KINDS}
    assert redaction.redact(masked) == (masked, {k: 0 for k in redaction.KINDS})
    assert len(redaction.redact(text, by_character=True)[0]) == len(text)
    assert redaction.redact("order 1234 5678 costs 12.50")[1]["card"] == 0


def test_amounts_in_both_notations(spark):
    raw = ["1.234,56", "1,234.56", "-12,00", "(5.00)", "7.50-", "1.234", "0,99"]
    rows = spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", M.amount(M.F.col("raw")).alias("cents")).collect()
    assert [r.cents for r in rows] == [123456, 123456, -1200, -500, -750, 123400, 99]


def test_statement_rows_and_balances(spark):
    text = "Opening balance 01.02.2024 EUR 100,00\n02.02.2024 Coffee shop -4,50 95,50\n03.02.2024 Salary EUR 1.000,00 1.095,50\nno row here\nClosing balance EUR 1.095,50"
    documents = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = statement.transactions(documents).orderBy("pos").collect()
    assert [(r.description, r.cents, r.balance) for r in rows] == [("Coffee shop", -450, 9550), ("Salary no row here", 100000, 109550)]
    assert [(r.doc_id, r.opening, r.closing) for r in statement.balances(documents).collect()] == [(1, 10000, 109550)]


def test_overlap_of_all_documents(spark, tmp_path):
    """Long words and spaceless scripts too, against plain windows and suffix comparison."""
    texts = ["a b c", "", None, " ".join(f"w{i}" for i in range(250)), " ".join(f"averyveryverylongword{i}" for i in range(90)), "x" * 2000, "日本語の文 " * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cost = lambda text: sum(len(re.findall(T.SPACELESS, w)) + sum(1 if len(p) <= 16 else -(-len(p) // 4) for p in re.split(T.SPACELESS, w) if p) for w in re.split(f"{T.SPACE}+", text) if w)
    expected = {}
    for k, text in enumerate(texts):
        made = [x for x, _ in chunking.windows(text or "", 100, 20)]
        shared = [0] + [max([n for n in range(1, min(400, len(a), len(b)) + 1) if b[:n] == a[-n:]], default=0) for a, b in zip(made, made[1:], strict=False)]
        shared = [0 if n >= len(x) else n for x, n in zip(made, shared, strict=False)]
        left = [re.sub(f"^{T.SPACE}+", "", x[n:]) if n else x for x, n in zip(made, shared, strict=False)]
        if made:
            expected[k] = (len(made), sum(shared), sum(math.ceil(cost(x) * 1.3) for x in left))
    got = {r.doc_id: (r.chunks, r.shared_chars, r.prompt_tokens) for r in search.chunk_overlap_general(spark, str(tmp_path)).collect()}
    assert got == expected and len(got) == 5


def test_edit_script_stops_at_its_limit():
    """One edit more than allowed gives none, whatever the texts."""
    r = random.Random(2)
    for _ in range(300):
        old, new = ([r.choice("abcde") for _ in range(r.randint(0, 12))] for _ in range(2))
        n = sum(kind != "equal" for kind, _, _ in compare.edit_script(old, new))
        assert compare.edit_script(old, new, n) is not None and (n == 0 or compare.edit_script(old, new, n - 1) is None)


@pytest.mark.parametrize("block", [1, 8, 9, 1 << 14])
def test_edit_script_of_any_length_is_shortest(block, monkeypatch):
    """however many edits, by fronts or by bits, with words that carry over the ends of blocks."""
    monkeypatch.setattr(compare, "BLOCK", block)
    r = random.Random(block)
    for middle in (compare._middle, lambda a, b, most=None: compare._halves(a, b)):
        monkeypatch.setattr(compare, "_middle", middle)
        for _ in range(150):
            old, new = (r.choices("abcdefgh"[: r.choice([2, 4, 8])], k=r.randint(0, 40)) for _ in range(2))
            common = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
            for i, x in enumerate(old):
                for j, y in enumerate(new):
                    common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
            script = compare.edit_script(old, new)
            n = sum(kind != "equal" for kind, _, _ in script)
            assert apply_script(old, new, script) == new and len(script) - n == common[-1][-1]
            assert n == 0 or compare.edit_script(old, new, n - 1) is None
    monkeypatch.undo()
    old = r.choices([f"w{k}" for k in range(300)], k=4000)
    new = r.sample(old, 4000)
    script = compare.edit_script(old, new)
    assert apply_script(old, new, script) == new and sum(kind != "equal" for kind, _, _ in script) > 1200


def test_changes_of_long_and_much_changed_documents(spark, tmp_path):
    """documents of more than 1200 edits, and of more than 20,000 words, have all their changes."""
    lengths = {0: 12, 1: 6010, 2: 20_500, 15: 6015}
    spark.createDataFrame([(k, " ".join(["the", "a", "cat"][i % 3] for i in range(n))) for k, n in lengths.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.pair_id, r.chunk): (r.changes, r.first_at) for r in compare_plans.change_chunks(spark, str(tmp_path)).collect()}
    expected = {(str(k), c): (len([i for i in range(50 * c, min(n, 50 * c + 50)) if i % 10 == 3]), 50 * c + 3) for k, n in lengths.items() if k % 15 for c in range(-(-n // 50))}
    assert got == expected and sum(c for c, _ in got.values()) == 601 + 2050


def test_files_of_all_kinds(spark, tmp_path):
    """Listing, limits and parsers on real files; a named file counts whatever its kind."""
    sub = tmp_path / "in" / "deep"
    sub.mkdir(parents=True)
    (sub / "a.TXT").write_bytes("\ufeffplain\ntext".encode())
    (sub / "b.md").write_text("before\n# One\nbody\n```\n# code\n```\n## Two ##\n\n")
    (sub / "c.csv").write_text('name,role\n"Lovelace, Ada","wrote ""notes"""\n\nBob,,extra\n')
    (sub / "d.tsv").write_text("only one row\tof two, cells\n")
    (sub / "e.bin").write_text("x")
    (sub / "f.log").write_text("y" * 200)
    (tmp_path / "named.bin").write_text("z")
    found = files.limited(files.listed(spark, [str(tmp_path / "in")], [str(tmp_path / "named.bin")]), 150)
    state = {r.path.rpartition("/")[2]: (r.kind, r.status, r.error, r.folder) for r in found.collect()}
    assert state == {"a.TXT": ("text", "queued", None, "deep"), "b.md": ("markdown", "queued", None, "deep"), "c.csv": ("csv", "queued", None, "deep"), "d.tsv": ("csv", "queued", None, "deep"), "f.log": ("text", "failed", "too-large", "deep"), "named.bin": (None, "failed", "unsupported", tmp_path.name)}
    rows = sorted((r.path.rpartition("/")[2], r.ordinal, r.label, r.text) for r in files.segments(spark, found).collect())
    assert rows == [("a.TXT", 0, None, "plain\ntext"), ("b.md", 0, None, "before"), ("b.md", 1, "One", "# One\nbody\n```\n# code\n```"), ("b.md", 2, "Two ##", "## Two ##"), ("c.csv", 0, None, 'name: Lovelace, Ada; role: wrote "notes"\nname: Bob; role: ; col3: extra'), ("d.tsv", 0, None, "only one row, of two, cells")]
    page = files.preview(spark.range(120).selectExpr("1 AS doc_id", "id AS ordinal"), 2).collect()
    assert [r.ordinal for r in sorted(page)] == list(range(100, 120)) and page[0].pages == 3


def test_csv_of_exports_is_read_back(spark):
    rows = spark.createDataFrame([(1, 0, "=1+1", 5, None), (1, 1, 'say "hi", now', -123456, 7)], "k int, pos int, what string, cents long, page int")
    made = exports.table_csv(rows, [("what", "what", "text"), ("cents", "amount", "money"), ("page", "page", "integer")], "k", "pos")
    assert made.collect()[0].csv == "what,amount,page\r\n'=1+1,0.05,\r\n\"say \"\"hi\"\", now\",-1234.56,7\r\n"
    back = files.csv_segments(made.select(made.k.alias("doc_id"), made.csv.alias("text"))).collect()[0].text
    assert back == "what: '=1+1; amount: 0.05; page: \nwhat: say \"hi\", now; amount: -1234.56; page: 7"


def test_stored_index_scores_as_a_scan(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["red", "green", "blue", "cyan", "the"], k=r.randint(0, 30)))) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    stored = retrieval.Index.build(chunks, str(tmp_path / "index"))
    for question in ("red the the", "blue", "nothing here", ""):
        scan = {x.chunk_id: x.score for x in retrieval.bm25(chunks, question).collect()}
        assert {x.chunk_id: x.score for x in stored.scores(question).collect()} == pytest.approx(scan)
    plan = stored.scores("red")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_nearest_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(compare, "ROWS", 16)
    r = random.Random(4)
    rows = [(k % 2, i, [r.gauss(0, 1) for _ in range(6)]) for i, k in enumerate(range(100))]
    frame = spark.createDataFrame(rows, "pair_id int, id int, vector array<double>")
    got = sorted((x.pair_id, x.id, x.other, x.rank) for x in compare.nearest(frame.where("id < 60"), frame.where("id >= 60"), 4).collect())
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    expected = []
    for p, i, v in rows[:60]:
        best = sorted((-round(cosine(v, w), 6), j) for q, j, w in rows[60:] if q == p)[:4]
        expected += [(p, i, j, k + 1) for k, (_, j) in enumerate(best)]
    assert got == sorted(expected)


def test_spans_are_spliced_in_order(spark):
    rows = spark.createDataFrame([("abcdef", [(4, 1, "X"), (0, 2, "-"), (1, 3, "no"), (5, 9, "no"), (3, 0, "no")])], "text string, spans array<struct<start:int,length:int,replacement:string>>")
    got = rows.select(edits.spliced(rows.text, rows.spans).alias("r")).collect()[0].r
    assert (got.text, got.applied) == ("-cdXf", 2)


def test_registry_checks_what_goes_in_and_out(spark):
    tools = compare_plans.registry()
    rows = spark.createDataFrame([(1, "a@b.org"), (2, None)], "doc_id long, text string")
    assert tools.names() == ["categorize_transactions", "count_selected_documents", "redact_documents", "summarize_cashflow"]
    assert tools.run(spark, "count_selected_documents", rows).collect()[0].documents == 2
    with pytest.raises(PermissionError):
        tools.run(spark, "redact_documents", rows)
    assert sorted(str(r.text) for r in tools.run(spark, "redact_documents", rows, confirmed=True).collect()) == ["None", "[EMAIL]"]
    with pytest.raises(ValueError, match="needs the columns"):
        tools.run(spark, "summarize_cashflow", rows)
    tools.add(skills.Tool("bad", lambda r: r, ("doc_id",), "other long"))
    with pytest.raises(ValueError, match="gives no other"):
        tools.run(spark, "bad", rows)
    with pytest.raises(ValueError, match="already"):
        tools.add(skills.Tool("bad", lambda r: r, ("doc_id",), "other long"))


def test_log_stream_over_several_batches(spark, tmp_path):
    """Batches as files; a stream that starts again goes on where it stopped."""
    folder = tmp_path / "events"
    for k in range(3):
        spark.createDataFrame([(i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(k * 40, k * 40 + 40)], "event_id long, t string").selectExpr("event_id", "CAST(t AS timestamp) AS ts").coalesce(1).write.parquet(str(folder / f"{k}"))
    schema = spark.read.parquet(str(folder / "0")).schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
        audit.bounded_log(rows, str(tmp_path / "out"), 50, 20).awaitTermination()
    kept = audit.latest_version(spark, f"{tmp_path}/out/log")
    assert sorted(r.event_id for r in kept.collect()) == list(range(70, 120))


def test_functions_in_sql_check_their_types(spark):
    skills.register_sql(spark, [skills.SqlTool("words_of", lambda t: ((w, len(w)) for w in (t or "").split()), ("string",), "word string, size int", rows=True), skills.SqlTool("odd_rows", lambda t: [(1,)], ("string",), "a int, b int", rows=True)])
    assert [tuple(r) for r in spark.sql("SELECT * FROM words_of('ab c')").collect()] == [("ab", 2), ("c", 1)]
    assert spark.sql("SELECT w.* FROM VALUES (1, CAST(NULL AS STRING)), (2, 'x y') AS t(i, s), LATERAL words_of(t.s) w").count() == 2
    with pytest.raises(Exception, match="takes"):
        spark.sql("SELECT * FROM words_of(1)").collect()
    with pytest.raises(Exception, match="rows of 1 values"):
        spark.sql("SELECT * FROM odd_rows('x')").collect()


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A writer that stops between two tables leaves the old state; of two writers one wins; deletes, repeats and compaction."""
    store = snapshots.Snapshots(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read() == {}
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "doc_id long, text string")
    store.change({"chunks": chunks, "vectors": chunks})
    old = store.read()

    def seen(version=None):
        return {k: sorted((r.doc_id or 0, r.text) for r in t.collect()) for k, t in store.read(version).items()}

    before = seen()
    new = spark.createDataFrame([(1, "z")], chunks.schema)

    def stop(self, version, changes):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "_commit", stop)
        with pytest.raises(RuntimeError):
            store.change({"chunks": new, "vectors": new}, new)
    assert seen() == before and store.version() == 1
    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "version", lambda self: 0)
        with pytest.raises(snapshots.Conflict):
            store.change({"chunks": new}, new)
    assert seen() == before
    store.change({"chunks": new, "vectors": new}, new)
    assert seen() == {k: [(0, "n"), (1, "z"), (2, "c")] for k in before}
    assert old["chunks"].count() == 4  # a plan made before goes on with what it saw
    store.change({"chunks": new})
    store.delete(spark.createDataFrame([(2,), (9,)], "doc_id long"))
    assert seen() == {"chunks": [(0, "n"), (1, "z"), (1, "z")], "vectors": [(0, "n"), (1, "z")]}
    last = seen()
    store.compact()
    store.clean()
    assert seen() == last


def test_files_within_limits(spark, tmp_path):
    """Each limit makes a failed row; what is too large isn't read."""
    import time

    for name, data in {"a.txt": b"one\ntwo", "b.txt": b"\xff", "c.txt": b"x" * 300, "d.txt": b"slow", "e.txt": b"p\n" * 9, "f.txt": b" ", "g.md": b"# t", "h.bin": b"?"}.items():
        (tmp_path / name).write_bytes(data)

    def lines(content):
        if content == b"slow":
            time.sleep(30)
        yield from ((None, line) for line in content.decode().split("\n"))

    found = files.listed(spark, [str(tmp_path)], [str(tmp_path / "h.bin"), str(tmp_path / "a.txt")])
    got = {r.path.rpartition("/")[2]: (r.status, r.error, len(r.pages)) for r in files.parsed(found, {"text": lines}, files.Limits(size=200, text=100, pages=5, seconds=0.4)).collect()}
    assert got == {"a.txt": ("parsed", None, 2), "b.txt": ("failed", "unreadable", 0), "c.txt": ("failed", "too-large", 0), "d.txt": ("failed", "timeout", 0), "e.txt": ("failed", "too-many-pages", 0), "f.txt": ("failed", "no-text", 0), "g.md": ("failed", "unsupported", 0), "h.bin": ("failed", "unsupported", 0)}
    texts = {r.path.rpartition("/")[2]: r.text for r in files.texts(spark, files.limited(found), 200).collect()}
    assert texts["a.txt"] == "one\ntwo" and texts["b.txt"] == "\ufffd" and texts["c.txt"] is None and "h.bin" not in texts


def test_streams_of_folders_and_files(spark, tmp_path):
    """A table may be a folder or a file; one that isn't there is an error; before the first version there is an empty table."""
    rows = spark.createDataFrame([(i, i % 3) for i in range(90)], "a long, b long")
    rows.repartition(4).write.parquet(str(tmp_path / "folder.parquet"))
    part = next((tmp_path / "folder.parquet").glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    for name in ("folder.parquet", "one.parquet"):
        stream = audit.table_stream(spark, str(tmp_path / name), per_batch=1)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"{name}-out")).count() == spark.read.parquet(str(tmp_path / name)).count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        audit.table_stream(spark, str(tmp_path / "none.parquet"))
    assert audit.latest_version(spark, str(tmp_path / "nothing"), rows.schema).count() == 0


def test_extraction_marks_every_chunk(spark, tmp_path):
    """Equal texts each have a marker; a changed text and an unread one are scanned again, others never."""
    schema = "doc_id long, chunk_id long, text string"
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, "b"), (2, 4, " "), (2, 5, None), (3, 6, "bad")], schema)
    reply = lambda text, attempt: 1 / 0 if text == "bad" else f'[{{"type": "date", "value": "{text}"}}]'
    first = extraction.scanned(rows, reply, "m")
    assert sorted((r.chunk_id, r.normalized) for r in first.where("record_type = '__scan__'").collect()) == [(1, "ok"), (2, "ok"), (3, "ok"), (6, "unparsed")]
    assert sorted(r.chunk_id for r in extraction.scanned(rows, reply, "m", first).collect()) == [6]
    assert extraction.scanned(rows, reply, "other", first).where("record_type = '__scan__'").count() == 4
    assert extraction.scanned(rows.limit(0), reply, "m").collect() == []
    source, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(source)
    for k in range(3):
        audit.extracted(audit.table_stream(spark, source), out, reply, "m").awaitTermination()
        if k == 0:
            spark.createDataFrame([(1, 1, "a"), (1, 2, "new"), (3, 6, "good")], schema).coalesce(1).write.mode("append").parquet(source)
    found = spark.read.parquet(f"{out}/records")
    assert sorted((r.chunk_id, r.scan, r.value) for r in found.where("record_type = 'date'").collect()) == [(1, 1, "a"), (2, 1, "a"), (2, 2, "new"), (3, 1, "b"), (6, 2, "good")]
    assert sorted((r.chunk_id, r.normalized) for r in extraction.current(found).collect()) == [(1, "a"), (1, "ok"), (2, "new"), (2, "ok"), (3, "b"), (3, "ok"), (6, "good"), (6, "ok")]


def test_replies_cut_at_every_length():
    """Whole elements of a cut array, as stepping back to each brace gives them."""
    import json

    def plain(text):
        at = len(text)
        while (at := text.rfind("}", 0, at)) > 0:
            try:
                return json.loads(text[: at + 1] + "]")
            except ValueError:
                pass
        return None

    whole = 'Sure [{"type": "date", "value": "a } ] b"}, {"type": "X", "value": 5}, 12, {"value": "é\\n"}, {"type": "PARTY ", "value": {"n": [1, {"k": 2}]}}, {"type": "amount", "value": " 5 EUR "}] done'
    for cut in range(len(whole) + 1):
        start = whole.find("[", 0, cut)
        assert extraction.whole_elements(whole[start:cut]) == plain(whole[start:cut]) if start >= 0 else True
    assert extraction.read_reply(whole) == [("date", "a } ] b"), ("generic", "é"), ("amount", "5 EUR")]
    assert extraction.read_reply("[]") == [] and extraction.read_reply("no") is None and extraction.read_reply(None) is None
    assert extraction.read_reply('[{"type": "date", "value": "x"}, {"ty') is None
    assert extraction.read_reply('[{"type": "date", "value": "x"}, {"ty', salvage=True) == [("date", "x")]


def test_figures_in_linear_time():
    """Runs of digit groups: equal to a plain search, and a hundred thousand groups at once."""
    import re
    import time

    def plain_cards(text, original):
        for run in re.finditer(r"(?<![A-Za-z0-9_])[0-9]+(?:[ -][0-9]+)*(?![A-Za-z0-9_])", text):
            edges = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer(r"\d+", run[0])]
            todo = [(0, len(edges))]
            while todo:
                first, last = todo.pop()
                spans = [(i - j, i, j) for i in range(first, last) for j in range(i + 1, min(last, i + 19) + 1)]
                for _, i, j in sorted(spans):
                    low, high = edges[i][0], edges[j - 1][1]
                    if 13 <= high - low <= 40 and not re.search("[–−]", original[low:high]) and redaction.luhn(re.sub(r"\D", "", text[low:high])):
                        yield low, high
                        todo += [(j, last), (first, i)]
                        break

    def plain_phones(text, original):
        number, at = re.compile(r"(?<![\d+])[+(]?\d(?:[ ./()-]{0,2}\d){5,}(?!\d)"), 0
        while m := number.search(text, at):
            ends = [m.start() + g.end() for g in re.finditer(r"\d+", m[0])]
            hit = next((e for e in reversed(ends) if redaction._is_phone(text[m.start() : e], original[m.start() : e])), None)
            if hit:
                yield m.start(), hit
            at = hit or ends[0]

    r = random.Random(3)
    for _ in range(8000):
        original = "".join(r.choices([" ", "-", "–", "1", "0", "4", "55", "123", "4567", "+", "(", ")", "/", ".", "x", "12", "9"], k=r.randint(1, 40)))
        text = original.translate(redaction._SHADOW)
        assert sorted(redaction.cards(text, original)) == sorted(plain_cards(text, original))
        assert list(redaction.phones(text, original)) == list(plain_phones(text, original))
    began = time.process_time()
    redaction.redact("12 " * 100_000)
    assert time.process_time() - began < 5


def test_invoice_lines_one_by_one(spark):
    """Labels, columns and weak readings of single lines, and lines that can't be read for certain."""
    texts = [
        "Netto 100,00 MwSt 20% 20,00 Brutto 120,00", "EUR\nWidget 2 20% 10,00 20,00\n1 Web hosting 12 Monate 1 0% 76,17 914,00\nSchrauben 4 Stk 8,00\nNetto-Miete Objekt 3 1.000,00\nSteuerberatung Jänner 500,00\nHosting 12,50 500\nWidget 10 100",
        "Total (excl. Tax) 914 $\nMwSt 20,00 %\nTotal (incl. Tax) 1.096,80 $", "Service A 700,00 $\nNet total 4 $\nTax 0 $\nTotal 914 $", "Service A 700,00 $\nNet total 700 $\nTax 20% 140 $\nTotal 840 $", "Gesamtbetrag -914 EUR", None, "", "Miete netto 1.000,00 EUR und mehr 5,00",
    ]
    rows = invoices.classed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: (r.net, r.tax, r.gross, r.rate) for r in invoices.totals(rows).collect()} == {0: (10000, 2000, 12000, None), 2: (91400, None, 109680, 20.0), 4: (70000, 14000, 84000, 20.0), 5: (None, None, -91400, None)}
    got = [(r.description, r.quantity, r.tax_rate, r.unit_price, r.cents) for r in invoices.items(rows).where("doc_id = 1").orderBy("pos").collect()]
    assert got == [("Widget", 2.0, 20.0, 1000, 2000), ("1 Web hosting 12 Monate 1 0%", None, None, 7617, 91400), ("Schrauben", 4.0, None, None, 800), ("Netto-Miete Objekt 3", None, None, None, 100000), ("Steuerberatung Jänner", None, None, None, 50000)]
    assert {r.doc_id: r.dropped for r in invoices.unread(rows).collect() if r.dropped} == {1: 2}


def test_tree_and_leaves_of_any_height(spark):
    """Seventy levels, a cycle, and a leaf that is reached twice."""
    nodes = [(1, 0, 0, True)]
    edges = [(1, k, k + 1, False, 0) for k in range(70)] + [(1, k, 1000 + k, True, 1) for k in range(0, 71, 10)] + [(1, 70, 5, False, 2), (1, 70, 1000, True, 3)]
    got = analysis.leaves(spark.createDataFrame(nodes, "doc_id int, node_id int, ordinal int, is_root boolean"), spark.createDataFrame(edges, "doc_id int, parent_id int, child_id int, child_is_leaf boolean, ordinal int"))
    assert [r.leaf_id for r in got.orderBy("place").collect()] == [1070, 1000, 1060, 1050, 1040, 1030, 1020, 1010]
    chunks = spark.createDataFrame([(1, i, "w w w w") for i in range(300)], "doc_id int, chunk_index int, text string")
    levels = {r.level: r.n for r in analysis.tree(chunks, 8, 4).groupBy("level").agg({"ordinal": "count"}).withColumnRenamed("count(ordinal)", "n").collect()}
    assert levels[1] == 150 and levels[max(levels)] == 1 and max(levels) == 9


def test_leaves_below_shared_nodes_and_in_order(spark):
    """Thirty layers of two shared nodes each, and random graphs with cycles against a walk in depth."""
    schema = "doc_id int, parent_id int, child_id int, child_is_leaf boolean, ordinal int"
    layers = [(1, 2 * k + a, 2 * k + 2 + b, False, b) for k in range(30) for a in range(2) for b in range(2)] + [(1, 60, 900, True, 0), (1, 61, 901, True, 0), (1, 0, 901, True, 5)]
    root = spark.createDataFrame([(1, 0, 0, True), (2, 0, 0, True)], "doc_id int, node_id int, ordinal int, is_root boolean")
    got = analysis.leaves(root.where("doc_id = 1"), spark.createDataFrame(layers, schema)).orderBy("place").collect()
    assert [r.leaf_id for r in got] == [900, 901]
    r = random.Random(5)
    for _ in range(4):
        edges = [(2, a, b if b < 9 else 100 + b, b >= 9, k) for a in range(9) for k, b in enumerate(r.sample(range(16), r.randint(0, 4)))]
        below, seen, out = {}, set(), []
        for _, a, b, leaf, k in sorted(edges, key=lambda e: (e[1], e[4])):
            below.setdefault(a, []).append((b, leaf))

        def walk(node):
            seen.add(node)
            for b, leaf in below.get(node, []):
                if leaf and b not in out:
                    out.append(b)
                if not leaf and b not in seen:
                    walk(b)

        walk(0)
        found = analysis.leaves(root.where("doc_id = 2"), spark.createDataFrame(edges or [(2, 50, 51, True, 0)], schema)).orderBy("place").collect()
        assert [x.leaf_id for x in found] == out


def test_greedy_groups_of_any_size(spark):
    """Equal to a plain loop over batches of any cut, with null keys, costs and oversized rows; a million children at once."""
    r = random.Random(9)
    rows = [(k, i, r.choice([None, 0, 1, 5, 30])) for k in ("a", "b", None, "c") for i in range(r.randint(1, 60))]
    frame = spark.createDataFrame(rows, "doc_id string, ordinal int, cost int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for least in (1, 2, 3):
            expected = {}
            for key in ("a", "b", None, "c"):
                total = n = group = 0
                for _, i, c in [x for x in rows if x[0] == key]:
                    if n >= least and total + (c or 0) > 25:
                        total, n, group = 0, 0, group + 1
                    total, n = total + (c or 0), n + 1
                    expected[key, i] = group
            assert {(x.doc_id, x.ordinal): x.group for x in grouping.greedy(frame, "doc_id", 25, least).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(1_000_000).selectExpr("1 AS doc_id", "id AS ordinal", "id % 7 AS cost")
    sizes = grouping.greedy(many, "doc_id", 1000).groupBy("group").agg({"cost": "sum"}).collect()
    assert 2995 < len(sizes) < 3020 and all(x["sum(cost)"] <= 1000 for x in sizes)
    assert grouping.greedy(frame.limit(0), "doc_id", 25).collect() == []


def test_windows_of_comparisons_and_translations(spark):
    """Long chunks are cut and keep their number, windows beyond the ceiling are left out, no text is lost in a translation."""
    words = [("p", 0, " ".join(f"w{i}" for i in range(450))), ("p", 1, " "), ("p", 2, "short one"), ("q", 0, None), ("p", 3, "x" * 2000)]
    rows = spark.createDataFrame(words, "pair_id string, ordinal int, text string")
    got = budgets.compare_windows(rows, 1024).orderBy("window").collect()
    assert [(x.tokens, x.ordinals) for x in got][:5] == [(100, [0]), (100, [0]), (100, [0]), (100, [0]), (52, [0, 2])] and sum(x.tokens for x in got[5:]) == 500 and all(x.tokens <= 100 for x in got)
    plan = budgets.compare_plan(rows, 1024).collect()
    assert [(p.pair_id, p.windows, p.truncated, p.answer_tokens, p.pair_words, p.steps) for p in plan] == [("p", len(got), False, 128, 100, len(got) + 2)]
    many = budgets.compare_plan(spark.createDataFrame([("p", i, "word " * 90) for i in range(20)], rows.schema), 1024).first()
    assert (many.windows, many.truncated, many.steps) == (12, True, 14)
    segments = spark.createDataFrame([(1, 0, 2, "a b"), (1, 1, 2, "c"), (1, 2, 5, " ".join(["y"] * 1500)), (1, 3, 4, "back"), (2, 0, None, "no page"), (3, 0, 1, "x")], "doc_id int, ordinal int, page int, text string")
    pages = spark.createDataFrame([(1, 8), (2, 4), (3, 1)], "doc_id int, page_count int")
    blocks = [(b.doc_id, b.kind, b.first, b.last) for b in budgets.translation_blocks(segments, pages, 8192).orderBy("doc_id", "block").collect()]
    assert blocks == [(1, "gap", 1, 1), (1, "window", None, None), (1, "gap", 3, 3), (1, "window", None, None), (1, "window", None, None), (1, "window", None, None), (1, "gap", 6, 8), (2, "window", None, None), (3, "window", None, None)]
    texts = " ".join(b.text for b in budgets.translation_blocks(segments, pages, 8192).where("doc_id = 1 AND kind = 'window'").orderBy("block").collect())
    assert texts.split() == "a b c".split() + ["y"] * 1500 + ["back"]


def test_differences_with_their_chunks(spark):
    """Real words that repeat: changes applied to the old text give the new one, and the chunks cited are those that changed."""
    r = random.Random(4)
    rows, pairs = [], []
    for p in range(12):
        old = [r.choices(["the", "a", "of", "in", "on", "it", "cat", "dog"], k=r.randint(1, 40)) for _ in range(3)]
        new = [list(w) for w in old]
        for _ in range(0 if p == 0 else r.randint(1, 5)):
            w = r.choice(new)
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 2)] = r.choices(["new", "the"], k=r.randint(0, 2))
        rows += [(2 * p, 100 * p + k, k, " ".join(w)) for k, w in enumerate(old)] + [(2 * p + 1, 100 * p + 50 + k, k, " ".join(w)) for k, w in enumerate(new)]
        pairs.append((p, 2 * p, 2 * p + 1))
        a, b = [x for w in old for x in w], [x for w in new for x in w]
        found = compare.in_context(a, compare.changes(a, b, compare.edit_script(a, b)))
        again, at = [], 0
        for c in found:
            assert b[c["to"] : c["to"] + c["come"]] == c["added"].split() and a[c["at"] : c["at"] + c["gone"]] == c["removed"].split()
            again += a[at : c["at"]] + c["added"].split()
            at = c["at"] + c["gone"]
        assert again + a[at:] == b
    schema = "doc_id int, chunk_id int, chunk_index int, text string"
    chunks = spark.createDataFrame(rows, schema)
    read = {x.pair_id: x for x in compare.difference_read(spark.createDataFrame([*pairs, (99, 0, 777)], "pair_id int, a int, b int"), chunks, 5000).collect()}
    assert read[0].identical and read[0].changes == compare.SAME and [(c.label, c.chunk_id) for c in read[0].cited] == [("S1", 0), ("S2", 50)]
    assert 99 not in read and all(x.added + x.removed > 0 and x.cited and x.redline for p, x in read.items() if not x.identical)
    one = spark.createDataFrame([(1, 1, 0, "a b c d e f g h"), (1, 2, 1, "i j k l"), (2, 3, 0, "a b c d e f g h"), (2, 4, 1, "i X k l m")], schema)
    got = compare.difference_read(spark.createDataFrame([(1, 1, 2)], "pair_id int, a int, b int"), one, 400).first()
    assert got.changes == '1. Changed: "j" → "X"  (context: …d e f g h i / k l…)\n2. Added: "m"  (context: …k l)' and got.redline == "1. …d e f g h i ~~j~~ **X** k l…\n2. …k l **m**"
    assert [(c.label, c.chunk_id) for c in got.cited] == [("S1", 2), ("S2", 4)] and (got.chunks_total, got.truncated) == (4, False)
    assert compare.fitted([{"at": k, "to": k, "gone": 1, "come": 0, "removed": "w", "added": "", "before": "", "after": ""} for k in range(300)], 60)[2] is True


def test_differences_of_long_and_unlike_documents(spark):
    """pairs with long texts, many edits, no equal word or changes beyond the budget have rows with all changes and all their chunks."""
    r = random.Random(6)
    plain = [f"w{k}" for k in range(50)]
    shuffled = r.choices(plain, k=3000)
    texts = {1: (["x y"] * 2, ["p q", "r s t"]), 2: (["a " * 15_000, "b " * 6000, "c"], ["a " * 15_000, "b " * 6000, "d"]), 3: ([" ".join(shuffled)], [" ".join(r.sample(shuffled, 3000))]), 4: (["e f", " ", "g"], ["e f", "", "g"])}
    rows = [(2 * p + side, f"{p}{'ab'[side]}{k}", k, x) for p, both in texts.items() for side in (0, 1) for k, x in enumerate(both[side])]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk_id string, chunk_index int, text string")
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in texts], "pair_id int, a int, b int")
    for budget in (5000, 20, 1):
        read = {x.pair_id: x for x in compare.difference_read(pairs, chunks, budget).collect()}
        assert sorted(read) == [1, 2, 3, 4]
        assert (read[1].removed, read[1].added, read[1].redline) == (4, 5, "1. ~~x y x y~~ **p q r s t**") and [c.chunk_id for c in read[1].cited] == ["1a0", "1a1", "1b0", "1b1"]
        assert (read[2].removed, read[2].added, [c.chunk_id for c in read[2].cited]) == (1, 1, ["2a2", "2b2"])
        a, b = ([w for x in side for w in x.split()] for side in texts[3])
        assert read[3].removed == read[3].added > 600 and read[3].redline.count("\n") + 1 == len(compare.between(a, b, compare.equal_runs(a, b))) > 200
        assert read[4].identical and read[4].redline == "" and read[4].fits
        assert (read[1].fits, read[1].truncated) == ((True, False) if budget > 1000 else (False, True) if budget == 1 else (read[1].fits, read[1].truncated))
        assert read[3].truncated and not read[3].fits
    assert read[1].changes == "(+1 further change(s) not listed)"


def test_compared_conversations_of_many_turns(spark, tmp_path):
    """every conversation has a row, and ids of chunks don't meet however many turns there are."""
    rows = [(c, t, " ".join("the cat sat on a mat by the old tree".split()[: 10 - t % 3])) for c in (3, 4, 5, 6, 7, 8) for t in range(310 if c < 6 else 3)] + [(11, 0, "far " * 20_100), (13, 0, "few far " * 10_100), (14, 0, ""), (14, 1, " ")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = compare_plans.compare_differences(spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = sql.execute(f"SELECT {', '.join(got.columns)} FROM ({compare_plans.ORACLE_SQL['compare_differences']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(found) and len(found) == 9


def test_swept_entities_do_not_meet_masks():
    text, found, masked, dropped = redaction.swept("Bob Red and Bobby met Red.", [("Bob", "name"), ("Bobby", "name"), ("Red", "other"), ("RED", "org"), ("ab", "name"), ("Bob", "org")])
    assert text == "[NAME] [REDACTED] and [NAME] met [REDACTED]." and (found["name"], found["other"], masked, dropped) == (2, 1, 4, 2)


def test_packed_windows_and_budgets(spark):
    r = random.Random(7)
    rows = [(d, i, r.randint(0, 9)) for d in range(5) for i in range(40)]
    got = {(x.doc_id, x.ordinal): x.window for x in budgets.packed(spark.createDataFrame(rows, "doc_id int, ordinal int, cost int").selectExpr("doc_id", "ordinal", "CAST(cost AS long) AS cost"), 12).collect()}
    expected = {}
    for d in range(5):
        total = window = 0
        for _, i, c in [x for x in rows if x[0] == d and x[2]]:
            if total and total + c > 12:
                total, window = 0, window + 1
            total += c
            expected[d, i] = window
    assert got == expected


def test_collections_are_merged(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, collection string")
    assert sorted(map(tuple, library.added(table, spark.createDataFrame([(1, "a"), (3, "c"), (3, "c")], table.schema), ["doc_id", "collection"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, library.removed(table, spark.createDataFrame([(1, "a"), (2, "x")], table.schema)).collect())) == [(2, "b")]
