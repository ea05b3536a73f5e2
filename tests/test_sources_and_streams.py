import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import documents, index, lexical
from paperloom.operators.state import fold_registry
from paperloom.plans import generation, retrieval
from paperloom.sources import commits, discovery, stores
from paperloom.streaming import streams


def test_token_stream_equals_batch(spark, tmp_path):
    rows = [("r1", 0, "See [1]", None), ("r1", 1, " and [2, 3].", "stop"), ("r2", 1, "b", "length"), ("r2", 0, "a", None), ("r3", 0, "open", None)]
    schema = "request_id string, seq long, text string, finish_reason string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = streams.answers(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("answers_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: (r["text"], r["n_tokens"], r["cited"], r["truncated"]) for r in spark.table("answers_out").collect()}
    assert got == {"r1": ("See [1] and [2, 3].", 2, [1, 2, 3], False), "r2": ("ab", 2, [], True)}
    batch = {r["request_id"]: r["text"] for r in streams.answers_batch(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {"r1": "See [1] and [2, 3].", "r2": "ab"}


def test_registry_sink_is_idempotent(spark, tmp_path):
    ev = spark.createDataFrame([("p", 1, 1, "discovered", None, None), ("p", 2, 1, "downloading", None, None)], "canonical_id string, seq long, version int, status string, path string, error string")
    sink = streams.registry_sink(str(tmp_path / "log"), str(tmp_path / "view"))
    sink(ev, 0)
    sink(ev, 0)
    assert streams.registry_view(spark, str(tmp_path / "view")).first()["attempts"] == 1
    # A later batch folds the records that it touches, over all of their events.
    sink(spark.createDataFrame([("p", 3, 1, "downloaded", "f", None), ("r", 1, 1, "discovered", None, None)], ev.schema), 1)
    now = {r["canonical_id"]: (r["status"], r["path"], r["attempts"]) for r in streams.registry_view(spark, str(tmp_path / "view")).collect()}
    assert now == {"p": ("downloaded", "f", 1), "r": ("discovered", None, 0)}


def test_requests_that_go_silent_are_told(spark, tmp_path):
    schema = "request_id string, seq long, text string, finish_reason string, ts timestamp"
    steps = [[("r3", 0, "open", None, "2024-01-01 00:00:00")], [("r1", 0, "x", "stop", "2024-01-01 02:00:00")], [("r2", 0, "y", "stop", "2024-01-01 04:00:00")]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = streams.answers(source, "10 minutes", "ts").writeStream.format("memory").queryName("silent_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: (r["text"], r["finish_reason"]) for r in spark.table("silent_out").collect()}
    assert got == {"r1": ("x", "stop"), "r2": ("y", "stop"), "r3": ("open", "timeout")}


def test_index_round_trip_and_mismatch(spark, tmp_path):
    path = str(tmp_path / "index")
    stores.write_index({"postings": spark.range(5)}, path, {"tokenizer": "technical_terms_v2"})
    frames, manifest = stores.read_index(spark, path)
    assert frames["postings"].count() == 5 and manifest["config"]["tokenizer"] == "technical_terms_v2"
    spark.range(3).write.mode("overwrite").parquet(f"{path}/postings")
    with pytest.raises(ValueError):
        stores.read_index(spark, path)


def test_vectors_upsert(spark, tmp_path):
    path = str(tmp_path / "vectors")
    make = lambda v, key="a": spark.createDataFrame([(key, v)], "chunk_id string, embedding array<float>")
    of = lambda df: {r["chunk_id"]: r["embedding"] for r in df.collect()}
    stores.upsert_vectors(spark, path, make([1.0, 0.0]), batch=9)
    stores.upsert_vectors(spark, path, make([0.0, 1.0]), batch=10)
    assert of(stores.latest(spark, path, "chunk_id")) == {"a": [0.0, 1.0]}
    # A second call without a batch adds to the first; a batch that is delivered again changes nothing.
    stores.upsert_vectors(spark, path, make([3.0, 1.0], "x"))
    stores.upsert_vectors(spark, path, make([9.0, 9.0]), batch=10)
    assert of(stores.upsert_vectors(spark, path, make([4.0, 1.0], "y"))) == {"a": [0.0, 1.0], "x": [3.0, 1.0], "y": [4.0, 1.0]}
    for bad in (make([1.0]).union(make([1.0, 2.0])), make([1.0, 2.0, 3.0], "z")):
        with pytest.raises(ValueError):
            stores.upsert_vectors(spark, path, bad)
    assert "z" not in of(stores.latest(spark, path, "chunk_id"))
    # What was not finished is not read.
    (tmp_path / "vectors" / "batch=99").mkdir()
    assert stores.batches(spark, path) == [9, 10, 11, 12]
    assert of(stores.upsert_vectors(spark, path, make([1.0, 2.0, 3.0]), recreate=True)) == {"a": [1.0, 2.0, 3.0]}


def test_first_version_of_an_index(spark, tmp_path):
    good = {"chunks": [{"chunk_id": "a", "text": "t"}], "tokenized_corpus": [["t"]]}
    (tmp_path / "one.json").write_text(json.dumps(good))
    frames, manifest = stores.read_index(spark, str(tmp_path / "one.json"))
    assert frames["chunks"].first()["chunk_id"] == "a" and frames["tokens"].first()["tokens"] == ["t"] and manifest["config"]["tokenizer"] == "word_v1"
    (tmp_path / "two.json").write_text(json.dumps({**good, "tokenized_corpus": []}))
    with pytest.raises(ValueError):
        stores.read_index(spark, str(tmp_path / "two.json"))


def test_documents_and_pages(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"paper_id": "p", "sections": {"method": "m"}, "metadata": {"title": "t"}}))
    row = stores.read_documents(spark, str(tmp_path / "d.json")).first()
    assert row["sections"] == {"method": "m"} and row["raw_document"] is None
    (tmp_path / "a.bin").write_bytes(b"one\ftwo")
    (tmp_path / "b.bin").write_bytes(b"bad")

    def parse(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().split("\f")

    got = stores.read_pages(spark, str(tmp_path / "*.bin"), parse).orderBy("path", "page_number").collect()
    assert [(r["page_number"], r["text"], r["char_count"]) for r in got] == [(1, "one", 3), (2, "two", 3), (None, None, None)]
    assert got[2]["error"] == "ValueError: broken"


def test_prompts_payloads_and_reports(spark, tmp_path):
    assert stores.render_prompt("Ask {{ q }} {x}", {"q": "x"}) == "Ask x {x}"
    for bad, values in (("{{q}} {{ r }}", {"q": "x"}), ("{{ q }}", {"q": " "})):
        with pytest.raises((KeyError, ValueError)):
            stores.render_prompt(bad, values)
    (tmp_path / "p.yaml").write_text("name: qa\nsystem: |\n  Be brief.\n  Cite.\nuser: 'Ask {{ q }}'\n")
    assert stores.load_prompt(str(tmp_path / "p.yaml")) == {"name": "qa", "system": "Be brief.\nCite.", "user": "Ask {{ q }}"}
    payload = {"data": json.dumps({"results": [{"title": "A", "id": 1}, {"title": "A", "summary": "s"}, {"title": "C", "url": "u"}, {"title": "bare"}]})}
    assert [p["title"] for p in discovery.items_of(payload)] == ["A", "C"]
    assert stores.markdown_table(spark.range(1).select(F.col("id"), F.lit(None).alias("x"))).splitlines()[2] == "| 0 |  |"
    report = stores.write_report({"means": spark.createDataFrame([(1, [2])], "a int, b array<int>")}, str(tmp_path / "report"), "Run")
    assert "# Run" in report and "| 1 | [2] |" in report and spark.read.json(str(tmp_path / "report" / "means.json")).count() == 1


class Fails:
    def search(self, query, max_results=50):
        raise RuntimeError("down")


def test_providers_with_injected_transports(spark):
    feed = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title> A
      title</title><author><name>Ann</name></author><category term="cs.CL"/><link title="pdf" href="http://p"/></entry></feed>"""
    asked = []
    arxiv = discovery.ArxivApi(get=lambda url, params, headers: asked.append(params) or feed)
    got = arxiv.search("x y", 3)
    assert got[0]["paper_id"] == "2101.00001v2" and got[0]["title"] == "A title" and got[0]["pdf_url"] == "http://p" and asked[0]["max_results"] == 3
    both = discovery.WithFallback(Fails(), arxiv).search("q", 1)
    assert both[0]["discovery_provider_used"] == "arxiv" and both[0]["fallback_reason"] == "down"
    remote = discovery.Remote(url="u", key="k", get=lambda url, params, headers: json.dumps({"papers": [{"title": "T", "id": "1"}], "auth": headers["authorization"]}).encode())
    assert remote.search("q")[0]["title"] == "T" and discovery.Remote(command="find", run=lambda args: json.dumps([{"title": args[-1], "id": 1}])).search("q", 7)[0]["title"] == "7"
    calls = []

    def tool(name, arguments):
        calls.append(arguments)
        return {"content": [{"text": "see 2101.00002" if len(calls) == 2 else "none"}]}

    server = discovery.ToolServer(tool, discovery.planned(spark, ["deep learning", "seismic waves", "x"], plan=lambda q, level: [{"keywords": [q], "question": "?", "difficulty": level}] * 3 if q == "x" else None))
    assert server.search("deep learning")[0]["arxiv_id"] == "2101.00002" and len(calls) == 2
    assert [c["keywords"] for c in calls] == [["deep learning", "deep", "learning"], ["deep learning", "deep", "learning"]] and [c["difficulty"] for c in calls] == [5, 7]
    assert [s["keywords"][0] for s in server.arguments["seismic waves"]] == ["seismic", "earthquake detection", "seismic waves"] and len(server.arguments["x"]) == 3
    with pytest.raises(ValueError):
        discovery.ToolServer(lambda name, arguments: {}, server.arguments).search("x")
    for bad in (lambda: arxiv.search(" "), lambda: arxiv.search("x", 0), lambda: discovery.build_discovery("nowhere"), lambda: discovery.build_discovery("auto"), lambda: discovery.Remote().search("q")):
        with pytest.raises(ValueError):
            bad()
    assert isinstance(discovery.build_discovery(" ENRICHED ", arxiv=arxiv), discovery.Overfetch) and discovery.build_discovery("arxiv", arxiv=arxiv) is arxiv


def test_a_tool_process_is_spoken_to_in_lines():
    import io

    class Process:
        def __init__(self, *args, **kw):
            self.stdin, self.returncode = io.StringIO(), 0
            self.stdin.close = lambda: None
            self.stdout = io.StringIO('log line\n{"id": 1, "result": {}}\n{"id": 2, "result": {"structuredContent": [{"title": "T", "id": 1}]}}\n')

        def poll(self):
            return 0

        def terminate(self):
            pass

        def wait(self, timeout):
            pass

    got = discovery.ToolProcess("server --x", start=Process)("find", {"q": 1})
    assert discovery.items_of(discovery.tool_payload(got))[0]["title"] == "T"


def test_downloads(spark, tmp_path):
    papers = spark.createDataFrame([("a", "a", "u/a"), ("b", "b", None), ("c", "c", "u/c")], "canonical_id string, paper_id string, url string")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1 there")

    def get(url):
        return 200, b"%PDF-1 new", {}

    got = {r["paper_id"]: r for r in discovery.download(papers, f"file://{tmp_path}", get).collect()}
    assert got["a"]["downloaded"] and got["b"]["error"] == "missing pdf_url" and got["c"]["skipped"]
    assert (tmp_path / "a.pdf").read_bytes() == b"%PDF-1 new" and (tmp_path / "c.pdf").read_bytes() == b"%PDF-1 there" and not list(tmp_path.glob("*.part*"))


def test_models_that_fail_are_tried_again_within_a_budget():
    class RateLimitError(Exception):
        retry_after = 7

    waits, now = [], [0.0]

    class Model:
        left = 2

        def complete(self, system, user):
            if Model.left:
                Model.left -= 1
                raise RateLimitError
            return "ok"

    limited = generation.Limited(Model(), per_minute=2, clock=lambda: now[0], sleep=lambda s: waits.append(s) or now.__setitem__(0, now[0] + s))
    assert limited.complete("", "") == "ok" and waits == [7, 7, 46.0]
    Model.left = 9
    with pytest.raises(RateLimitError):
        generation.Limited(Model(), attempts=2, sleep=lambda s: None).complete("", "")


def test_unknown_plans_and_options():
    for bad in ("nowhere", {"kind": "sparse", "depth": 1}, {"kind": "fallback", "what": 1}, {"kind": "dense", "corpus": 1}):
        with pytest.raises(ValueError):
            retrieval.build(bad)
    with pytest.raises(ValueError):
        T.tokenizer_of({"stop_words_removed": True})
    for bad in ({"": "x"}, {"a": []}, {"a": [" "]}):
        with pytest.raises(ValueError):
            T.checked_expansions(bad)


def test_batches_of_two_writers_both_count_and_lost_races_are_tried_again(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/store"
    rows = [spark.createDataFrame([("k", i), (f"own{i}", i)], "key string, n int") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda r: stores.upsert(r, path, "key"), rows))
    assert sorted(numbers) == stores.batches(spark, path) == [1, 2, 3, 4, 5, 6]
    got = {r["key"]: r["n"] for r in stores.latest(spark, path, "key").collect()}
    assert {k: v for k, v in got.items() if k != "k"} == {f"own{i}": i for i in range(6)} and got["k"] in range(6)
    # A state that a lost writer left half written is passed over.
    number, state = commits.read(spark, path)
    (tmp_path / f"store/_commits/{number + 1:09d}.json").write_text('{"folders": [')
    assert commits.read(spark, path) == (number, state)
    with pytest.raises(commits.Conflict):
        commits.write(spark, path, number, state)


@pytest.mark.parametrize("bucketed", [False, True])
def test_merged_batches_hold_what_they_held(spark, tmp_path, monkeypatch, bucketed):
    monkeypatch.setattr(stores, "MERGE_AFTER", 3)
    path = f"file://{tmp_path}/store"
    want = {}
    for i in range(8):
        new = {f"k{j % 5}": f"v{i}" for j in range(i, i + 3)}
        want |= new
        stores.upsert(spark.createDataFrame(list(new.items()), "key string, v string"), path, "key", batch=100 - i, bucketed=bucketed)
    assert {r["key"]: r["v"] for r in stores.latest(spark, path, "key").collect()} == want
    state = commits.read(spark, path)[1]
    assert len(state["folders"]) <= 4 and any(name.startswith("merged-") for _, name in state["folders"]) and state["done"] == [[93, 100]]
    stores.upsert(spark.createDataFrame([("k0", "again")], "key string, v string"), path, "key", batch=97)  # delivered before
    stores.compact(spark, path, "key")
    assert {r["key"]: r["v"] for r in stores.latest(spark, path, "key").collect()} == want
    folders = {p.name for p in (tmp_path / "store").iterdir() if p.name.startswith(("data-", "merged-"))}
    now = commits.read(spark, path)[1]
    assert folders == {name for _, name in now["folders"]} | set(now["old"])


def test_registry_of_shuffled_and_repeated_batches_reads_no_older_events(spark, tmp_path):
    import random
    import shutil

    rng = random.Random(7)
    schema = "canonical_id string, seq long, version int, status string, path string, error string"
    events = [(f"p{rng.randrange(6)}", i, rng.choice([1, 1, 2, 3, None]), rng.choice(["downloading", "failed", None]), rng.choice([None, f"f{i}"]), rng.choice([None, f"e{i}"])) for i in range(120)]
    batches = [events[k::5] for k in range(5)]
    sink = streams.registry_sink(str(tmp_path / "log"), str(tmp_path / "view"))
    for number in (3, 0, 4, 0, 2, 1, 4):
        sink(spark.createDataFrame(batches[number], schema), number)
        shutil.rmtree(tmp_path / "log")  # what was folded is not needed again
    got = sorted(map(tuple, streams.registry_view(spark, str(tmp_path / "view")).collect()))
    assert got == sorted(map(tuple, fold_registry(spark.createDataFrame(events, schema)).collect()))


def test_answers_are_made_once_whatever_is_lost(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Model:
        def complete(self, system, user):
            (calls / uuid.uuid4().hex).write_text(user)
            if user == "bad":
                raise ValueError("no")
            return f"{user} {uuid.uuid4().hex}"  # another answer each time

    prompts = spark.createDataFrame([(i, "s", f"u{i % 4}") for i in range(12)] + [(99, "s", "bad")], "query_id long, system string, user string")
    ledger = f"file://{tmp_path}/ledger"
    first = {r["query_id"]: r["answer"] for r in generation.once(prompts, Model, "query_id", ledger, "m").collect()}
    asked = sorted(p.read_text() for p in calls.iterdir())
    assert asked == ["bad", "u0", "u1", "u2", "u3"] and first[0] == first[4] == first[8] and first[99] is None
    spark.catalog.clearCache()
    again = {r["query_id"]: r["answer"] for r in generation.once(prompts, Model, "query_id", ledger, "m").collect()}
    assert again == first and len(list(calls.iterdir())) == 6  # the failed call is tried again, no other


# ---- the stored index -----------------------------------------------------------


def test_search_of_the_index_is_that_of_the_documents(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)] + [("blank", " "), ("none", None), (None, "w1 w2")], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 5, 20])] + [(98, "unheard"), (99, None)], "query_id long, text string")
    path = f"file://{tmp_path}/index"
    assert index.search(queries, path, 5).count() == 0
    i = F.regexp_extract("chunk_id", r"\d+", 0).try_cast("int")
    index.append(docs.where(i % 3 == 0), path, block_docs=8)
    index.append(docs.where((i % 3 > 0) | (i % 6 == 0)), path, block_docs=8)  # some are there already
    index.append(docs.where("chunk_id IN ('blank', 'none') OR chunk_id IS NULL"), path)  # nothing new
    whole = f"file://{tmp_path}/whole"
    index.append(docs, whole, block_docs=8)
    known = docs.where("chunk_id IS NOT NULL")
    for k in (1, 7, 1000):
        want = sorted(map(tuple, lexical.search(queries, known, k, key="chunk_id").collect()))
        assert sorted(map(tuple, index.search(queries, path, k).collect())) == want == sorted(map(tuple, index.search(queries, whole, k).collect()))
    assert commits.read(spark, path)[1]["sums"] == pytest.approx(commits.read(spark, whole)[1]["sums"])
    merged = index.merge(spark, path)
    assert len(merged["segments"]) == 1 and sorted(map(tuple, index.search(queries, path, 7).collect())) == sorted(map(tuple, lexical.search(queries, known, 7, key="chunk_id").collect()))


def test_blocks_that_cannot_reach_the_best_are_not_opened(spark, tmp_path):
    # A term that is frequent in a few documents, and stands once in very many longer ones.
    rows = [(i, "rare rare rare rare x") for i in range(12)] + [(100 + i, "rare " + "y z " * 40) for i in range(800)] + [(1000 + i, f"other words here {i}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    path = f"file://{tmp_path}/index"
    index.append(docs, path, block_docs=16)
    queries = spark.createDataFrame([(1, "rare")], "query_id long, text string")
    got = index.opened(queries, path, 5).agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
    assert got["n"] > 50 and got["open"] <= 12
    assert sorted(map(tuple, index.search(queries, path, 5).collect())) == sorted(map(tuple, lexical.search(queries, docs, 5, key="chunk_id").collect()))
    # Of the folders of terms, only the query's is scanned.
    plan = index._plan(queries, path, "query_id", T.technical_tokens)[1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan)


def test_index_writers_that_meet_are_told(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "chunk_id long, text string")
    index.append(docs.where("chunk_id = 1"), path)
    read = commits.read

    def late(spark_, path_):
        got = read(spark_, path_)
        if not late.done:
            late.done = True
            index.append(docs.where("chunk_id = 2"), path)
        return got

    late.done = False
    monkeypatch.setattr(commits, "read", late)
    with pytest.raises(commits.Conflict):
        index.append(docs, path)
    assert commits.read(spark, path)[1]["sums"]["n"] == 2


# ---- cleaning and windows ---------------------------------------------------------


def test_cleaning_keeps_control_characters_and_knows_all_white_space(spark):
    rows = [
        ("see https://a.b/c\u00a0and the", "see and the"), ("ab-\u00a0\ncd", "abcd"), ("a\x01b\x02c", "a\x01b\x02c"), (r"\emph{\alpha x} \alpha \b{} z", "\\alpha x  z"), ("x\n\u3000\u0663\u2003\ny", "x\n\ny"),
        (r"\cmd{a}\cmd*{b}\\c", "ab c"), ("", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r["c"] for r in df.select("i", documents.clean_text("t").alias("c")).orderBy("i").collect()]
    want = []
    W = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    for t, _ in rows:  # the rule, by Python's expressions
        t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", (t or "").replace("\0", " "))
        t = re.sub(r"(?m)^\s*\d+\s*$", "", t)
        t = re.sub(rf"\\(?:[a-zA-Z]+\*?|.)[{W}]*(?:\{{([^{{}}]*)\}})?", lambda m: m[1] or " ", t)
        t = re.sub(r"https?://\S+", " ", t)
        t = "\n".join(x.strip() for x in t.splitlines())
        t = re.sub(r"(?<![.!?:;])\n(?!\n)", " ", t)
        want.append(re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t)).strip())
    assert got == want


def test_what_plans_wrote_on_their_way_is_removed(spark):
    stores.drop_kept(spark)
    kept = stores.kept(spark.range(3), "some")
    path = stores._made[0]
    assert kept.count() == 3 and stores.exists(spark, path)
    stores.drop_kept(spark)
    assert not stores.exists(spark, path) and not stores._made


def test_what_was_fetched_is_in_the_second_context_whatever_ranks_before_it(spark):
    class Model:
        def complete(self, system, user):
            return "So [1]." if "fetched" in user else "Insufficient evidence."

    said = {"q1": "alpha beta gamma", "q2": "delta epsilon zeta"}
    copies = [(f"c{i:02}", f"p{i}", "T", "Method", " ".join([said["q1"]] * 9)) for i in range(30)]
    other = [(f"d{i:02}", "p", "T", "Method", " ".join(f"w{i}x{j}" for j in range(200))) for i in range(30)]
    chunks = spark.createDataFrame(copies + other, "chunk_id string, paper_id string, title string, section string, text string")
    questions = spark.createDataFrame(list(said.items()), "query_id string, text string")
    titles = spark.createDataFrame([], "norm string, title string")

    def enrich(poor):
        return poor.select(F.concat(F.lit("new-"), "query_id").alias("chunk_id"), F.lit("new").alias("paper_id"), F.lit("New").alias("title"), F.lit("Method").alias("section"), F.concat("text", F.lit(" fetched")).alias("text"))

    rows = generation.chat(questions, retrieval.Corpus(chunks), titles, Model, "s", "{{ question }}\n{{ context }}", enrich=enrich).collect()
    assert {(r["query_id"], r["answered_by"], r["answer"], r["context_chunk_ids"][0]) for r in rows} == {(q, "enriched", "So [1].", f"new-{q}") for q in said}
    # The corpus is still searched for the second answer.
    assert "c00" in next(r["context_chunk_ids"] for r in rows if r["query_id"] == "q1")


def test_a_search_without_terms_reads_no_documents(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("read")).cast("string").alias("text"))
    queries = spark.createDataFrame([("q", " "), ("r", None)], "query_id string, text string")
    found = lexical.search(queries, docs, 4)
    assert found.collect() == [] and found.dtypes == [("query_id", "string"), ("doc_id", "bigint"), ("score", "double"), ("rank", "int")]
