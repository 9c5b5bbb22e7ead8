"""Streams, generation, records, rule tables, concepts, scanners, listings and uploads against plain loops."""

import json
import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave import config as C
from factweave.operators import concepts as K
from factweave.operators import evaluate as E
from factweave.operators import generation as L
from factweave.operators import records as D
from factweave.operators import recover as V
from factweave.operators import risk as R
from factweave.operators import rules as U
from factweave.plans import queries as Q
from factweave.sources import readers, tables, uploads
from factweave.streaming import monitor as M

ARTIFACT = "run long, doc long, ts timestamp, kind string"


def artifacts(spark, rows, path):
    frame = spark.createDataFrame(rows, "run long, doc long, at long, kind string")
    frame.select("run", "doc", F.timestamp_seconds("at").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(path)


def progress(spark, path, totals, stall):
    stream = spark.readStream.schema(ARTIFACT).parquet(path)
    return M.progress_stream(stream, spark.createDataFrame(totals, "run long, n_total long"), "10 minutes", stall)


def test_monitor_goes_on_after_a_restart_and_reports_stalls(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(4), d, 1_700_000_000 + 60 * d, rng.choice(["done", "done", "error", "retry", "other"])) for d in range(400)]
    rows = [r for r in rows if r[0] != 3 or r[1] < 100]
    totals = [(0, 20), (1, 10_000), (3, 10_000)]
    for k in range(3):
        artifacts(spark, rows[k * 130 : (k + 1) * 130 if k < 2 else None], f"{tmp_path}/in")
        got = {r.run: r for r in M.run_once(progress(spark, f"{tmp_path}/in", totals, 3600), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    at_once = {r.run: r for r in M.run_once(progress(spark, f"{tmp_path}/in", totals, 3600), f"{tmp_path}/out2", f"{tmp_path}/state2").collect()}
    assert set(got) == {0, 1, 3}
    for run, n_total in totals:
        own, seen = [r for r in rows if r[0] == run], []
        for r in own:
            if sum(x[3] == "done" for x in seen) < n_total:
                seen.append(r)
        count = lambda k: sum(x[3] == k for x in seen)  # noqa: B023, E731
        last = seen[-1][2]
        recent = sum(x[3] == "done" and x[2] // 60 > last // 60 - M.WINDOW for x in seen)
        for r in (got[run], at_once[run]):
            assert (r.done, r.errors, r.retries, r.finished) == (count("done"), count("error"), count("retry"), count("done") >= n_total)
            assert r.started.timestamp() == seen[0][2] and r.seen.timestamp() == last
            assert r.rate_avg == pytest.approx(count("done") / ((last - seen[0][2]) / 60), abs=1e-6) and r.rate_window == pytest.approx(recent / M.WINDOW, abs=1e-6)
    assert got[0].finished and got[0].eta_min is None and not got[0].stalled and got[3].stalled and not got[1].stalled
    history = M.snapshots(spark, f"{tmp_path}/out")
    assert history.select("batch_id").distinct().count() > 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, 5, 2, 0, 0, 1, 2, 2, False, False)], M._SHOWN)
    other = batch.withColumn("done", F.lit(3).cast("long"))
    sink = M.upsert(f"{tmp_path}/t")
    for b, n in ((batch, 0), (other, 1), (batch, 0), (batch.limit(0), 2), (other, 1)):
        sink(b, n)
    assert sorted((r.batch_id, r.done) for r in M.snapshots(spark, f"{tmp_path}/t").collect()) == [(0, 2), (1, 3)]
    assert [r.done for r in M.latest(M.snapshots(spark, f"{tmp_path}/t")).collect()] == [3]


def test_follow_stops_when_all_runs_have_ended(spark, tmp_path):
    artifacts(spark, [(0, d, 1_700_000_000 + d, "done") for d in range(5)], f"{tmp_path}/in")
    late = threading.Timer(6, lambda: artifacts(spark, [(1, d, 1_700_000_100 + d, "done") for d in range(5)], f"{tmp_path}/in"))
    late.start()
    got = M.follow(progress(spark, f"{tmp_path}/in", [(0, 5), (1, 5)], 3600), f"{tmp_path}/out", f"{tmp_path}/state", 2, "1 second").collect()
    late.join()
    assert {(r.run, r.done, r.finished) for r in got} == {(0, 5, True), (1, 5, True)}


# --- generation --------------------------------------------------------------------------------------


def test_formats_are_tried_from_strict_to_lax():
    def client(refused):
        def ask(prompt, form):
            if form in refused:
                raise RuntimeError(str(form))
            return f"{form}"

        return ask

    assert L.ask_with_formats(client([]), "p", "schema") == ("schema", ["schema"])
    assert L.ask_with_formats(client(["schema"]), "p", "schema") == ("json_object", ["schema", "json_object"])
    assert L.ask_with_formats(client(["schema", "json_object"]), "p", "schema") == ("None", ["schema", "json_object", "none"])
    assert L.ask_with_formats(client(["baseline"]), "p", "baseline")[1] == ["baseline", "json_object"]
    with pytest.raises(L.Refused):
        L.ask_with_formats(client([None]), "p", None)


def test_requests_run_side_by_side_in_order_and_are_bounded(spark):
    prompts = spark.createDataFrame([(k, f"{k}") for k in range(40)], "hadm_id long, prompt string").coalesce(1)

    def make():
        import threading as t

        lock, live, most = t.Lock(), [0], [0]

        def ask(prompt, form):
            with lock:
                live[0] += 1
                most[0] = max(most[0], live[0])
            time.sleep(0.05)
            with lock:
                live[0] -= 1
            return f"{prompt}:{most[0]}"

        return ask

    got = L.completions(prompts, make, 5).collect()
    assert [r.raw.split(":")[0] for r in got] == [str(r.hadm_id) for r in got] == [str(k) for k in range(40)]
    assert 2 <= max(int(r.raw.split(":")[1]) for r in got) <= 5


def test_answers_are_written_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def answer(rows):
        def run(frames):
            for f in frames:
                asked.add(len(f))
                yield pd.DataFrame({"hadm_id": f["hadm_id"], "raw": "x", "error": [None if k % 5 or bad else "no" for k in f["hadm_id"]]})

        return rows.mapInPandas(run, "hadm_id long, raw string, error string")

    wanted, bad = spark.range(20).toDF("hadm_id"), False
    assert L.once_written(wanted.filter("hadm_id < 12"), answer, f"{tmp_path}/a").count() == 12 and asked.value == 12
    assert L.once_written(wanted, answer, f"{tmp_path}/a").filter("error IS NOT NULL").count() == 4 and asked.value == 12 + 8 + 3
    bad = True
    assert L.once_written(wanted, answer, f"{tmp_path}/a").filter("error IS NULL").count() == 20 and asked.value == 23 + 4


# --- records -----------------------------------------------------------------------------------------


def test_records_come_from_the_writing_job_and_runs_go_on(spark, tmp_path):
    docs = spark.range(50).toDF("hadm_id")
    stages = [("a", lambda x: x.withColumn("v", F.col("hadm_id") * 2)), ("b", lambda x: x.filter("hadm_id % 2 = 0").select("hadm_id", "v"))]
    spark.sparkContext.setJobGroup("records", "records")
    first = D.run_stages(docs.filter("hadm_id < 30"), stages, f"{tmp_path}/run", {"even": F.count_if(F.col("v") % 4 == 0)})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("records")) == 2
    assert [(r["stage"], r["docs"], r["rows"], r["even"]) for r in first] == [("a", 30, 30, 15), ("b", 30, 15, 15)]
    more = D.run_stages(docs, stages, f"{tmp_path}/run")
    assert [(r["docs"], r["rows"]) for r in more] == [(20, 20), (35, 10)]
    again = D.run_stages(docs.filter("hadm_id % 2 = 0"), stages, f"{tmp_path}/run")
    assert [r["rows"] for r in again] == [0, 0]
    assert spark.read.parquet(f"{tmp_path}/run/b").count() == 25


def test_summary_table_and_csv(spark, tmp_path):
    lines = lambda rows: spark.createDataFrame(rows, "hadm_id long, pos long, line string")
    pred = lines([(1, 1, "LABS|Sodium|138|Admission"), (1, 2, "VITALS|Heart Rate|80|Admission"), (2, 1, "LABS|BUN|9|Past"), (3, 1, "LABS|BUN|9|Past")])
    truth = lines([(1, 1, "LABS|Sodium|139|Admission"), (1, 2, "LABS|BUN|9|Admission"), (2, 1, "LABS|BUN|9|Past"), (4, 1, "LABS|BUN|9|Past")])
    rows = D.stage2_rows(pred, truth, spark.createDataFrame([(1, True), (2, False)], "hadm_id long, json_ok boolean"))
    got = {r.hadm_id: r for r in rows.collect()}
    assert {k: (r.stage1_json_ok, r.stage2_lines, r.tp, r.fp, r.fn, r.precision, r.f1) for k, r in got.items()} == {1: ("yes", 2, 1, 1, 1, 0.5, 0.5), 2: ("no", 1, 1, 0, 0, 1.0, 1.0), 4: ("unknown", 0, 0, 0, 1, 0.0, 0.0)}
    assert D.write_summary(rows, f"{tmp_path}/s") == {"stage": "summary", "rows": 3}
    md = [r.value for r in spark.read.text(f"{tmp_path}/s/summary_md").collect()]
    assert len(md) == 5 and md[0].startswith("| hadm_id | stage1_json_ok |") and md[2].startswith("| 1 | yes | 2 | 0.5 |")
    assert spark.read.csv(f"{tmp_path}/s/summary_csv", header=True).columns == D.ROW


# --- rules and concepts ------------------------------------------------------------------------------


def test_interval_index_equals_first_match(spark):
    rng = random.Random(7)
    rules = [("LABS", f"k{rng.randrange(3)}", i, float(lo := rng.randrange(60)), float(lo + rng.randrange(-2, 15)), i % 11) for i in range(300)]
    values = [("LABS", f"k{rng.randrange(4)}", rng.choice([float(rng.randrange(-3, 80)), rng.random() * 80, None, float("nan"), float("inf")])) for _ in range(600)]
    index = U.index(spark.createDataFrame(rules, U.RULE))
    got = U.with_points(spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, cluster string, keyword string, value_num double"), index)
    want = {i: next((p for c2, k2, _, lo, hi, p in rules if (c2, k2) == (c, k) and x is not None and lo <= x <= hi), None) for i, (c, k, x) in enumerate(values)}
    assert {r.i: r.points for r in got.collect()} == want


def test_a_large_rule_table_does_not_grow_the_plan(spark):
    rules = spark.range(10_000).selectExpr("'LABS' AS cluster", "concat('k', id % 7) AS keyword", "id AS ord", "CAST(id AS DOUBLE) AS lo", "CAST(id + 5 AS DOUBLE) AS hi", "CAST(id % 9 AS INT) AS points")
    index = U.index(rules)
    began = time.time()
    made = U.with_points(spark.createDataFrame([("LABS", "k3", 3.0)], "cluster string, keyword string, value_num double"), index)
    made._jdf.queryExecution().executedPlan()
    assert time.time() - began < 1 and [r.points for r in made.collect()] == [3]


def test_rules_and_groups_from_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"LABS": {"Sodium": {"ranges": [{"min": 100, "max": 120, "score": 5}, {"max": 110, "score": 3}, {"min": 130, "score": 1}]}}}))
    index = U.index(U.from_json(spark, f"{tmp_path}/rules.json"))
    rows = spark.createDataFrame([("LABS", "Sodium", x) for x in (90.0, 105.0, 125.0, 999.0)], "cluster string, keyword string, value_num double")
    assert {r.value_num: r.points for r in U.with_points(rows, index).collect()} == {90.0: 3, 105.0: 5, 125.0: None, 999.0: 1}
    (tmp_path / "groups.json").write_text(json.dumps({"groups": [{"id": "g", "risk_weight": 4, "synonyms": ["Chest Pain", "cp"]}, {"id": "h", "risk_weight": 2, "synonyms": ["cp", "pain"]}]}))
    found = K.from_json(spark, f"{tmp_path}/groups.json", "SYMPTOMS")
    assert found == [("SYMPTOMS", "Chest Pain", "g", 4), ("SYMPTOMS", "cp", "g", 4), ("SYMPTOMS", "cp", "h", 2), ("SYMPTOMS", "pain", "h", 2)]
    facts = spark.createDataFrame([("SYMPTOMS", k) for k in ("CP", " chest pain ", "painful", "cpx", "back pain", None, "")], "cluster string, keyword string")
    assert {r.keyword: r.gid for r in K.with_groups(facts, found).collect()} == {"CP": "g", " chest pain ": "g", "painful": "h", "cpx": None, "back pain": "h", None: None, "": None}


def test_automaton_equals_the_scan_of_all_synonyms(spark):
    rng = random.Random(2)
    words = sorted({w for _, s, _, _ in K.from_config() for w in s.split()}) + ["and", "of", "x", "tia", "-", "/"]
    keywords = [(rng.choice(["PROBLEMS", "SYMPTOMS"]), rng.choice(["", " "]) + rng.choice([" ", "-", "/", ""]).join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for _ in range(400)]
    frame = spark.createDataFrame(keywords, "cluster string, keyword string").distinct()
    rows = lambda x: sorted((r.cluster, r.keyword, r.gid or "", r.weight or 0) for r in x.collect())
    assert rows(K.with_groups(frame)) == rows(R.with_groups(frame).select("cluster", "keyword", "gid", "weight"))


def test_cost_of_the_automaton_does_not_grow_with_synonyms():
    few = K.Synonyms([(f"word{i}", "g", 1) for i in range(100)])
    many = K.Synonyms([(f"word{i}", "g", 1) for i in range(100)] + [(f"other{i}", "h", 1) for i in range(100_000)])
    texts = [f"some text with word{i % 100} in it" for i in range(5_000)]

    def seconds(x):
        began = time.perf_counter()
        assert all(x.best(t) == ("g", 1) for t in texts)
        return time.perf_counter() - began

    assert min(seconds(many) for _ in range(3)) < 3 * min(seconds(few) for _ in range(3)) + 0.02


# --- evaluation --------------------------------------------------------------------------------------


def greedy(pred, truth, timestamp):
    """The outcomes of (cluster, keyword, present, ts) facts of one document, walked through in order."""
    taken, out = set(), []
    norm = lambda k: " ".join(k.split()).lower()
    for c, k, present, ts in pred:
        same = [i for i, x in enumerate(truth) if norm(x[1]) == norm(k)]
        why, hit = "value_mismatch" if same else "not_in_gt", None
        for i in same:
            if i in taken:
                continue
            if timestamp and truth[i][3] != ts:
                why = "timestamp_mismatch"
            elif present is None or truth[i][2] is None or truth[i][2] != present:
                why = "value_mismatch"
            else:
                hit = i
                break
        if hit is None:
            out.append((c, k, "fp", why))
        else:
            taken.add(hit)
            out.append((truth[hit][0], truth[hit][1], "tp", ""))
    return sorted(out + [(*x[:2], "fn", "") for i, x in enumerate(truth) if i not in taken])


@pytest.mark.parametrize("timestamp", [False, True])
def test_exact_reasons_of_semantic_facts(spark, timestamp):
    rng = random.Random(3)
    value = {True: "yes", False: "no", None: "odd"}
    docs = {}
    for d in range(60):
        side = lambda: list({(c, k): (c, k, rng.choice([True, False, None, True]), rng.choice(["Past", "Admission"])) for c, k in [(rng.choice(["PROBLEMS", "SYMPTOMS"]), rng.choice(["CHF", "chf", "Chf ", "a  b", "A b", "z"]).strip()) for _ in range(rng.randrange(1, 8))]}.values())
        docs[d] = side(), side()
    frame = lambda s: spark.createDataFrame([(d, i, f"{c}|{k}|{value[p]}|{t}") for d, x in docs.items() for i, (c, k, p, t) in enumerate(x[s])], "hadm_id long, pos long, line string")
    got = {}
    for r in E.compare(frame(0), frame(1), require_timestamp=timestamp, semantic=True).collect():
        got.setdefault(r.hadm_id, []).append((r.cluster, r.keyword, r.outcome, r.reason or ""))
    assert {d: sorted(x) for d, x in got.items()} == {d: greedy(p, t, timestamp) for d, (p, t) in docs.items()}


def test_examples_are_limited_before_the_shuffle(spark):
    rows = [(1, i, f"odd {i}") for i in range(50)] + [(1, 99, "A|not stated|B"), (2, 1, "END"), (2, 2, "LABS|Na|1|Past")]
    lines = spark.createDataFrame(rows, "hadm_id long, pos long, line string")
    got = {r.hadm_id: r for r in E.with_examples(lines).collect()}
    assert got[1].raw_invalid_examples == [f"odd {i}" for i in range(5)] and got[1].raw_kvt3_not_stated_examples == ["A|not stated|B"] and got[1].raw_invalid_lines == 50
    assert got[2].raw_invalid_examples == [] and got[2].raw_kvt3_not_stated_examples == []
    plan = E.first_lines(lines, F.lit(True), "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(hadm_id") < plan.rindex("WindowGroupLimit")


# --- texts and files ---------------------------------------------------------------------------------


def walked(text):
    """The first object and the healed rest, character by character."""
    if not text or "{" not in text or text.rfind("}") < text.find("{"):
        return None, None
    body, first, healed, depth, inside, spared = text[text.find("{") : text.rfind("}") + 1], None, "", 0, False, False
    for i, x in enumerate(body):
        new = x
        if inside:
            if spared:
                spared = False
            elif x == '"':
                inside = False
            elif x == "\\":
                spared = True
            elif x in "\n\r":
                new = {"\n": "\\n", "\r": "\\r"}[x]
        elif x == '"':
            inside = True
        elif x in "{}":
            depth += 1 if x == "{" else -1
            if depth == 0 and x == "}" and first is None:
                first = body[: i + 1]
        healed += new
    return first, healed


def test_scanner_equals_a_walk_over_characters_and_is_linear():
    rng = random.Random(1)
    for _ in range(3_000):
        text = "".join(rng.choice(['"', "{", "}", "\\", "\n", "\r", "a", ":", " "]) for _ in range(rng.randrange(30)))
        assert V.scan_object(text) == walked(text), text
    long = '{"a": "' + 'x\n\\"y{' * 200_000 + '"} z'
    began = time.time()
    first, healed = V.scan_object(long)
    assert time.time() - began < 1 and len(long) > 1_000_000 and json.loads(healed)["a"].count("\n") == 200_000 and first == long[:-2]


def test_uploads_of_every_kind(spark, tmp_path):
    text = "Zeile <1> & \"q\"\n\n  zwei\tTab é 中"
    for name, content in {"a.txt": text.encode(), "b.MD": text.encode(), "c.docx": uploads.docx_bytes(text), "d.json": b'{"x": 1}', "e.csv": b"a,b\n1,\xff", "f.pdf": b"%PDF", "g.docx": b"no zip", "h.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in uploads.uploaded(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == got["b.MD"] == got["c.docx"] == (text, None) and got["d.json"][0] == '{"x": 1}' and got["e.csv"][0] == "a,b\n1,�" and "h.txt" not in got
    assert got["f.pdf"] == (None, "unsupported ending: pdf") and got["g.docx"][0] is None and got["g.docx"][1].startswith("not a document")


def test_listing_reads_names_alone(spark, tmp_path):
    for k in (3, 12, 100):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / f"ehr_{k}.txt").write_text(f"note {k}")
        time.sleep(0.02)
    (tmp_path / "12" / "ground_truth_12.json").write_text("[]")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "ehr_1.txt").write_text("no")
    files = readers.listing(spark, str(tmp_path), "ehr_*.txt")
    assert sorted(r.hadm_id for r in files.collect()) == [3, 12, 100]
    plan = readers.done_range(files)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan and "content" not in plan
    r = readers.done_range(files).first()
    assert (r.done, r.oldest, r.newest) == (3, 3, 100) and r.newest_mtime > r.oldest_mtime
    assert [(r.hadm_id, r.text) for r in readers.notes(spark, str(tmp_path), first=2).collect()] == [(100, "note 100"), (12, "note 12")]
    assert [r.hadm_id for r in readers.notes(spark, str(tmp_path), with_truth=True).collect()] == [12]
    assert sorted(r.text for r in readers.notes(spark, str(tmp_path)).collect()) == ["note 100", "note 12", "note 3"]
    assert readers.notes(spark, str(tmp_path), with_truth=True, first=5).count() == 1


def test_tables_are_in_the_shared_folder(spark):
    place = tables.new_place(spark, "x")
    assert place.startswith(tables.shared_dir(spark)) and tables.exists(spark, place)
    assert tables.kept(spark.range(3), f"{place}/t").count() == 3


def test_scores_by_table_equal_scores_by_literals(spark, sf):
    facts = Q.scored(spark, sf)
    by = {r.keyword: r for r in U.index(U.from_config(spark)).collect()}
    assert {len(r.bounds) for r in by.values()} and set(by) == {k for _, k in C.RANGES}
    rows = lambda x: sorted((r.hadm_id, r.cluster, r.score) for r in x.collect())
    assert rows(R.cluster_scores(facts, U.index(U.from_config(spark)), K.from_config())) == rows(R.cluster_scores(facts))


def test_artifacts_are_staged_whole_and_put_in_place_once(spark, tmp_path):
    rows = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "hadm_id long, md string")
    read = lambda: sorted((r.hadm_id, r.md) for r in spark.read.parquet(f"{tmp_path}/a").collect())
    readers.write_artifacts(rows(range(20), "x"), f"{tmp_path}/a", "stage1_md", 4)
    readers.write_artifacts(rows([3, 30], "y"), f"{tmp_path}/a", "stage1_md", 4)
    assert read() == sorted([(i, "y" if i in (3, 30) else "x") for i in (*range(20), 30)])
    assert not tables.exists(spark, f"{tmp_path}/a/_staged_stage1_md")
    # a run that ended between staging and replacing: its rows are put in place by the next one
    left = rows([5, 40], "z").withColumn("kind", F.lit("stage1_md")).withColumn("bucket", F.pmod(F.xxhash64("hadm_id"), F.lit(4)).cast("int"))
    old = spark.read.parquet(f"{tmp_path}/a").select("hadm_id", "md", "kind", "bucket").join(left.select("bucket").distinct(), "bucket", "left_semi").filter("hadm_id <> 5")
    left.unionByName(old).write.parquet(f"{tmp_path}/a/_staged_stage1_md")
    readers.write_artifacts(rows([7], "w"), f"{tmp_path}/a", "stage1_md", 4)
    assert dict(read()) == {**{i: "x" for i in range(20)}, 3: "y", 30: "y", 5: "z", 40: "z", 7: "w"}


def test_tables_of_the_first_stage(spark):
    answers = spark.createDataFrame([(1, 'a {"A": 1, "B": "___"} z', "full", True, 1, False, False, False, False), (2, None, None, False, 3, False, False, False, False)], f"hadm_id long, {L._FIRST.replace('error string, ', '')}")
    md = spark.createDataFrame([(1, "## A\nx")], "hadm_id long, md string")
    made = readers.stage1_artifacts(answers, md, spark.createDataFrame([(1, 0, "LABS|Na|1|Past")], "hadm_id long, pos long, line string"), ["A", "B", "C"])
    assert set(made) == {"stage1_raw", "stage1_json", "stage1_md", "stage1_facts", "stage1_meta"}
    assert {r.hadm_id: (r.json_ok, r.missing_keys, r.md_chars, r.had_placeholders) for r in made["stage1_meta"].collect()} == {1: (True, ["C"], 6, True), 2: (False, ["A", "B", "C"], 0, False)}
    assert {r.hadm_id: r.json for r in made["stage1_json"].collect()} == {1: '{"A": 1, "B": "___"}', 2: None}
    for kind, df in made.items():
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == readers.ARTIFACTS[kind]


def test_notes_without_fall_back_and_empty_ones(spark):
    from factweave.operators import service

    def down():
        def ask(prompt, form):
            raise RuntimeError("down")

        return ask

    notes = spark.createDataFrame([(1, "A 75 year-old male, HR: 90."), (2, " "), (3, None)], "hadm_id long, text string")
    lost = service.analyse(notes, down, fall_back=False)
    assert {r.hadm_id: (r.backend, r.error) for r in lost.documents.collect()} == {1: ("client", "pipeline_error: down"), 2: ("none", "empty_input"), 3: ("none", "empty_input")}
    assert lost.facts.isEmpty() and lost.scores.isEmpty()
    ruled = service.analyse(notes)
    assert [r.hadm_id for r in ruled.scores.collect()] == [1] and {(r.keyword, r.value) for r in ruled.facts.collect()} == {("Age", "75"), ("Sex", "male"), ("Heart Rate", "90")}
    again = service.analyse(notes, down)
    assert again.facts.count() == 3 and again.documents.filter("hadm_id = 1").first().backend == "rules after the client"


def test_record_of_two_runs(spark):
    from factweave.operators import gates as G

    rows = lambda x: spark.createDataFrame(x, "hadm_id long, kind string, text string")
    a = rows([(1, "j", '{"normalized": [1], "x": 1}'), (2, "t", "same"), (9, "t", "not wanted")])
    b = rows([(1, "j", '{"x": 2, "normalized": [1]}'), (2, "t", "other"), (3, "t", "new")])
    meta = lambda v: spark.createDataFrame([tuple(f"{k}{v}" for k in G.RUN_KEYS)], ", ".join(f"{k} string" for k in G.RUN_KEYS))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "hadm_id long")
    diffs, one = G.ab_record(a, b, docs, meta("a"), meta("b"), ["j"])
    assert sorted((r.hadm_id, r.kind, r.note) for r in diffs.collect()) == [(2, "t", "content_diff"), (3, "t", "missing_file")]
    r = one.first()
    assert (r.n_hadm, r.n_diffs, r.model_a, r.scope_b) == (3, 2, "modela", "scopeb")
    strict, _ = G.ab_record(a, b, docs, meta("a"), meta("b"), ["j"], strict=True)
    assert (1, "j", "json_bytes_diff") in {(r.hadm_id, r.kind, r.note) for r in strict.collect()}


def test_counts_of_extracted_lines(spark):
    lines = spark.createDataFrame([(1, 0, "END"), (1, 1, "A|not stated|B"), (1, 2, "CLUSTER|LABS|Na|1|Past"), (1, 3, "LABS|Na|1|Past"), (1, 4, "LABS|Na|1|Past")], "hadm_id long, pos long, line string")
    shown = lambda r: (r.raw_total_lines, r.raw_valid_kvt4_lines, r.raw_invalid_lines, r.raw_duplicates_exact, r.raw_recovered_cluster_prefix_lines, r.raw_end_lines, r.raw_kvt3_not_stated_lines)
    assert shown(E.format_stats(lines).first()) == (3, 2, 1, 1, 1, 1, 1)
    assert shown(E.format_stats(lines, extracted=True).first()) == (5, 2, 3, 1, 0, 0, 0)


def test_texts_of_reference_facts(spark, tmp_path):
    for k, x in {1: {"raw": "LABS|Na|1|Past\n\n VITALS|HR|80|Past "}, 2: {"text": "", "raw": "LABS|K|4|Past"}, 3: {"facts": [], "lines": ["LABS|K|5|Past"]}, 4: [{"C": "LABS", "K": "Na", "V": 2, "T": "Past"}], 5: {"text": "prose"}}.items():
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / f"ground_truth_{k}.json").write_text(json.dumps(x))
    got = sorted((r.hadm_id, r.line) for r in readers.truth(readers.truth_files(spark, str(tmp_path))).collect())
    assert got == [(1, "LABS|Na|1|Past"), (1, "VITALS|HR|80|Past"), (2, "LABS|K|4|Past"), (3, "LABS|K|5|Past"), (4, "LABS|Na|2|Past")]


def test_narrative_facts_carry_their_cluster(spark):
    text = "**CLUSTER:** DEMOGRAPHICS\n**Keyword:** Sex\n**Value:** male\n**Timestamp:** Admission\nkeyword: Age\nprose in between\nValue: **75**\nCluster: labs\nValue: 9\nKeyword: Na\nValue: 1\nValue: 2\nkeyword: K"
    rows = spark.createDataFrame([(1, text), (2, "Keyword: lost\nValue: 1")], "hadm_id long, text string")
    assert [(r.hadm_id, r.line) for r in V.narrative_facts(rows).orderBy("n").collect()] == [(1, "DEMOGRAPHICS|Sex|male|Admission"), (1, "DEMOGRAPHICS|Age|75|Unknown"), (1, "LABS|Na|2|Unknown")]


def test_summaries_read_a_table_of_facts(spark, sf):
    from factweave.plans import runs

    made = runs.stage2_summary(spark, sf)
    assert "lineitem" not in made._jdf.queryExecution().executedPlan().toString() and made.count() > 0
