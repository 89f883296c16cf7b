import pytest

from trajspark.operators import label_audit

ENTRY = ("e string, failure_class string, tau int, T int, has_logprobs boolean, success boolean, "
         "injection struct<applied_count:int>, trace_sha256 string")
STEP = ("e string, t int, token_logprobs array<double>, error boolean, task string, "
        "tool_events array<struct<result:string>>, calls array<struct<result:string>>")


def step(e, t, *results, error=False, task="go"):
    calls = [(r,) for r in results]
    return (e, t, None, error, task, calls, calls)


def test_every_verdict(spark):
    cases = {
        "marker": ("timeout", ["ok", "it timed out after 30s !"]), "mapped": ("tool_cascade", ["ok", "net::ERR_CONNECTION_TIMED_OUT"]),
        "other marker": ("rate_limit", ["ok", "it timed out after 30s"]), "before onset": ("timeout", ["timed out after 30s", "fine"]),
        "json": ("malformed_json", ["ok", '{"a": [1, 2}']), "good json": ("malformed_json", ["ok", '{"a": [1, 2]}']),
        "shuffled": ("context_corruption", ["ok", "b a $17 "]), "document": ("grounding_loss", ["ok", "Basalt columns form as thick lava flows cool"]),
        "silent": ("looping", ["ok", ""]), "bound": ("looping", ["ok", "x"]), "stale": ("looping", ["ok", "x"])}
    entries = [(k, cls, 1, 3, None, None, (1,) if k in ("bound", "stale") else None, "d-" + k) for k, (cls, _) in cases.items()]
    rows = [s for k, (_, r) in cases.items() for s in (step(k, 0, r[0]), step(k, 1, r[1]), step(k, 2, ""))]
    digests = spark.createDataFrame([("bound", "d-bound"), ("stale", "changed")], "e string, digest string")
    out = label_audit.audit_labels(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(rows, STEP), ["e"], digests=digests)
    got = {r.e: (r.verdict, r.defects) for r in out.collect()}
    yes = {"marker", "mapped", "json", "shuffled", "document", "bound"}
    for k in cases:
        want = ("confirmed", []) if k in yes else ("unverifiable", ["unverifiable_positive"]) if k == "silent" else ("no_op", ["no_op_positive"])
        assert got[k] == want, k


def test_defects_and_null_metadata(spark):
    entries = [("null", None, None, None, None, None, None, None), ("short", "looping", 2, 3, True, None, None, None),
               ("gone", "looping", 0, 3, None, None, None, None), ("no tau", "looping", None, 4, None, None, None, None),
               ("failed", None, None, 1, False, False, None, None)]
    rows = [step("null", 0), *[step("short", t, "r") for t in range(3)], step("no tau", 0, "r", task=None), step("failed", 0, "r")]
    out = label_audit.audit_labels(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(rows, STEP), ["e"])
    assert {r.e: (r.defects, r.blocking) for r in out.collect()} == {
        "null": (["legacy_text_only_telemetry"], []), "short": (["logprob_flag_mismatch", "no_post_onset_steps"], ["no_post_onset_steps"]),
        "gone": (["missing_trace_file"], ["missing_trace_file"]),
        "no tau": (["manifest_T_mismatch", "labelled_without_tau", "no_task_recorded"], ["manifest_T_mismatch", "labelled_without_tau"]),
        "failed": (["unsuccessful_healthy"], ["unsuccessful_healthy"])}


def test_retirement_survives_a_kill_at_every_point(spark, tmp_path, monkeypatch):
    entries = spark.createDataFrame([(str(i), i) for i in range(10)], "e string, v int")
    audited = spark.createDataFrame([(str(i), ["no_op_positive"] if i < 3 else []) for i in range(10)] + [("1", ["missing_trace_file"])],
                                    "e string, blocking array<string>")

    def state(path):
        moved = label_audit.rejected(spark, path)
        return (sorted(r.e for r in label_audit.accepted(spark, path).collect()),
                sorted((r.e, r.reason) for r in moved.collect()) if moved is not None else [])

    after = ([str(i) for i in range(3, 10)], [("0", "retroactive gate: no_op_positive"),
             ("1", "retroactive gate: missing_trace_file, no_op_positive"), ("2", "retroactive gate: no_op_positive")])
    commit, original = label_audit._commit, type(entries.write).parquet

    def killed(*_):
        raise KeyboardInterrupt

    for point in ("rejected", "accepted", "commit"):
        path = str(tmp_path / point)
        label_audit.create_labels(entries, path)
        before = state(path)
        with monkeypatch.context() as m:
            if point == "commit":
                m.setattr(label_audit, "_commit", killed)
            else:
                m.setattr(type(entries.write), "parquet", lambda self, out, *a, **k: killed() if out.endswith(point) else original(self, out, *a, **k))
            with pytest.raises(KeyboardInterrupt):
                label_audit.retire(spark, path, audited, ["e"])
        assert state(path) == before == ([str(i) for i in range(10)], [])
        assert label_audit.retire(spark, path, audited, ["e"]) == 1
        assert state(path) == after
        assert label_audit.retire(spark, path, audited, ["e"]) == 1 and state(path) == after
    with pytest.raises(Exception, match="already exists"):
        commit(spark, path, 1, "second writer")
    assert label_audit.retire(spark, path, spark.createDataFrame([("9", ["no_op_positive"])], "e string, blocking array<string>"), ["e"]) == 2
    assert state(path)[0] == [str(i) for i in range(3, 9)] and len(state(path)[1]) == 4
