"""Operators of the segment-selection domain, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from tessel.functions import scalars as S
from tessel.operators import cues, gate, intervals, memo, ranking, segments, settings
from tessel.sources import documents


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_parse_signal(spark):
    raw = "noise\nframe:0 pts_time:0.5\nlavfi.scd.mafd=1\nframe:1    pts_time:1.5\nlavfi.scd.mafd=9\nlavfi.scd.mafd=32.371\nlavfi.scd.time=1.5\nframe:2 pts_time:x\nlavfi.scd.mafd=y"
    got = intervals.parse_signal(spark.createDataFrame([("a", raw)], "clip string, raw string"))
    assert rows(got, "frame", "t", "mafd", "cut") == [(1, 0.5, 1.0, False), (2, 1.5, 32.371, True), (3, 0.0, 0.0, False)]


def test_cuts_and_shots(spark):
    frames = spark.createDataFrame([("a", 0.5, 0.0, True), ("a", 1.5, 0.0, True), ("a", 9.8, 0.0, True), ("a", 4.0, 0.0, False)], "clip string, t double, mafd double, cut boolean")
    clips = spark.createDataFrame([("a", 10.0), ("b", 2.0)], "clip string, duration double")
    assert rows(intervals.interior_cuts(frames, clips), "clip", "t") == [("a", 1.5)]
    cut = spark.createDataFrame([("a", 3.0), ("a", 6.0)], "clip string, t double")
    assert rows(intervals.shots(cut, clips), "clip", "start", "stop") == [("a", 0.0, 3.0), ("a", 3.0, 6.0), ("a", 6.0, 10.0), ("b", 0.0, 2.0)]


def test_candidates(spark):
    clips = spark.createDataFrame([("dyn", 20.0), ("sta", 30.0), ("short", 2.0), ("tiny", 0.5), ("mix", 9.0)], "clip string, duration double")
    shots = spark.createDataFrame([("dyn", 0, 0.0, 20.0), ("sta", 0, 0.0, 30.0), ("short", 0, 0.0, 2.0), ("tiny", 0, 0.0, 0.5), ("mix", 0, 0.0, 0.5), ("mix", 1, 0.5, 8.5)], "clip string, shot bigint, start double, stop double")
    frames = spark.createDataFrame([("dyn", 1.0, 9.0), ("dyn", 19.0, 9.0), ("sta", 2.0, 0.1)], "clip string, t double, mafd double")
    got = rows(intervals.candidates(shots, clips, frames), "clip", "part", "start", "stop")
    assert [g for g in got if g[0] == "sta"] == [("sta", 0, 11.0, 19.0)] and [g for g in got if g[0] != "dyn" and g[0] != "sta"] == [("mix", 0, 0.5, 8.5), ("short", 0, 0.0, 2.0), ("tiny", 0, 0.0, 0.5)]
    dyn = [g for g in got if g[0] == "dyn"]
    assert len(dyn) == 3 and dyn[-1][3] == 20.0 and all(b - a <= 8 for _, _, a, b in dyn)
    times = intervals.sample_times(spark.createDataFrame([(0.0, 4.0), (2.0, 8.0)], "start double, stop double"))
    assert sorted(r.times for r in times.collect()) == [[0.0, 1.0, 2.0, 3.0], [2.0, 3.5, 5.0, 6.5]]


def test_metrics(spark):
    lines = spark.createDataFrame([(1, "blur", 4.0), (1, "blur", 6.0), (1, "YAVG", 110.0), (1, "YMIN", 4.0), (1, "YMIN", 9.0), (1, "YMAX", 250.0), (2, "x", 1.0)], "id int, name string, x double")
    assert rows(gate.video_metrics(lines, ["id"]), "id", "blur", "luma", "luma_min", "luma_max") == [(1, 5.0, 110.0, 4.0, 250.0), (2, 0.0, 0.0, 0.0, 0.0)]
    inf = float("-inf")
    sound = spark.createDataFrame([(1, "RMS_level", -20.0), (1, "RMS_level", -30.0), (1, "RMS_level", inf), (1, "Peak_level", -10.0), (2, "RMS_level", inf), (3, "RMS_level", -9.0), (3, "silence_start", 0.0)], "id int, name string, x double")
    assert rows(gate.audio_metrics(sound, ["id"]), "id", "rms", "peak", "silent") == [(1, -25.0, -10.0, False), (2, -120.0, -120.0, True), (3, -9.0, -120.0, True)]


def test_gate(spark):
    data = [(4, 30, 120, 0), (4, 5, 10, 0), (4, 5, 250, 0), (0.5, 5, 120, 0), (4, 5, 120, 40), (5, 5, 120, 5)]
    frame = spark.createDataFrame([(i, "balanced", *map(float, d)) for i, d in enumerate(data)], "id int, profile string, seconds double, blur double, luma double, motion double")
    got = {r.id: r for r in gate.gate(frame, gate.profiles(spark)).collect()}
    assert [got[i].reasons for i in range(6)] == [["excessive blur"], ["severely underexposed"], ["severely overexposed"], ["shorter than one second"], ["excessive camera shake"], []]
    assert [got[i].hard for i in range(6)] == [True] * 4 + [False, False] and [got[i].eligible for i in range(6)] == [False] * 5 + [True]
    kept = {r.id: r for r in gate.gate(frame, gate.profiles(spark), stabilise=True).collect()}[4]
    assert kept.eligible and kept.needs_stabilisation and kept.reasons == []


def test_majority_and_ties(spark):
    frame = spark.createDataFrame([(1, "p", 2.0), (1, "p", 2.0), (1, "l", 3.0), (2, "p", 1.0), (2, "l", 1.0)], "g int, o string, w double")
    assert rows(gate.majority(frame, ["g"], "o", "w"), "g", "winner") == [(1, "p"), (2, None)]


def test_targets(spark):
    frame = spark.createDataFrame([(100.0, 45.0), (100.0, 0.0), (1000.0, 0.0), (6.0, 0.0), (800.0, 0.0), (900.0, 0.0)], "e double, o double")
    assert [round(r[0], 9) for r in frame.select(S.target_duration(F.col("e"), F.col("o"))).collect()] == [45, 30, 120, 6, 120, 120]


def test_selection(spark):
    kind = "g int, ord bigint, seconds double, base double, redundancy double, subjects array<string>, actions array<string>"
    best = spark.createDataFrame([(1, 0, 5.0, 0.2, 0.0, ["a"], ["x"]), (1, 1, 5.0, 0.9, 0.0, ["b"], ["y"]), (1, 2, 5.0, 0.8, 0.0, ["c"], ["z"])], kind)
    assert rows(ranking.select_diverse(best, ["g"], 8.0).filter("chosen"), "ord") == [(1,), (2,)]
    twins = spark.createDataFrame([(1, 0, 5.0, 0.9, 0.8, ["Dog"], ["run"]), (1, 1, 5.0, 0.8, 0.8, [" dog "], ["RUN"]), (1, 2, 5.0, 0.7, 0.8, ["dog"], ["jump"])], kind)
    assert rows(ranking.select_diverse(twins, ["g"], 60.0).filter("chosen"), "ord") == [(0,), (2,)]
    assert rows(ranking.select_prefix(best, ["g"], F.lit(8.0)).filter("chosen"), "ord") == [(1,), (2,)]


def test_scores(spark):
    good = '{"visual_interest": 0.5, "energy": 0.5, "usefulness": 1, "redundancy": 0}'
    contents = [good, f"<think>{{}}</think>{good}", "{}", '{"energy": 2}', '{"energy": "x"}', "none", f"<think>open {good}", "", f"```json\n{good}\n```"]
    frame = spark.createDataFrame([(i, 1, c, good if i == 7 else "") for i, c in enumerate(contents)] + [(3, 2, good, "")], "id int, attempt int, content string, reasoning string")
    got = {r.id: (r.score is not None, r.repaired) for r in ranking.score_with_repair(frame, ["id"]).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (False, False), 6: (False, False), 7: (True, False), 8: (True, False)}


def test_terms_and_arc(spark):
    frame = spark.createDataFrame([(["Dog", "dog "],), (["dog", "cat"],), (["", "ant"],)], "t array<string>")
    assert [(r.term, r.n) for r in ranking.term_counts(frame, [], "t").orderBy("rank").collect()] == [("dog", 2), ("ant", 1), ("cat", 1)]
    arc = spark.createDataFrame([(1, 0, 0.9, 0.1), (1, 1, 0.2, 0.1), (1, 2, 0.5, 0.1), (1, 3, 0.5, 0.9)], "g int, ord bigint, energy double, base double")
    assert [r.ord for r in ranking.energy_arc(arc, ["g"]).orderBy("place").collect()] == [1, 3, 2, 0]


def test_cues(spark):
    assert one(spark, cues.clean(F.array(*map(F.lit, [2.0, 2.0, -1.0, 1.0, 5.0, 12.0])), F.lit(10.0)))[0] == [1.0, 2.0, 5.0]
    assert one(spark, cues.clean(F.array(*map(F.lit, [0.0, 0.006, 0.012, 0.03])), F.lit(10.0)))[0] == [0.0, 0.012, 0.03]
    beats = spark.createDataFrame([(1, i / 2) for i in range(64)], "g int, t double")
    marked = cues.marks(beats, ["g"])
    assert marked.filter("phrase").count() == 8 and marked.filter("section").count() == 2
    grid = spark.createDataFrame([(1, "beat", 2.0), (1, "beat", 4.2), (1, "phrase", 4.0)], "g int, kind string, t double")
    bounds = spark.createDataFrame([(1, 0, 2.2, False), (1, 1, 2.9, False), (1, 2, 4.3, True), (1, 3, 1.995, False)], "g int, id int, boundary double, major boolean")
    assert rows(cues.prior_cue(bounds, grid, ["g"]).fillna({"kind": "-", "cue": -1.0}), "id", "kind", "cue") == [(0, "beat", 2.0), (1, "-", -1.0), (2, "phrase", 4.0), (3, "beat", 2.0)]
    text = spark.createDataFrame([(1, "0.5 x\nbad\n\n 1.5")], "g int, raw string")
    assert rows(cues.first_fields(text, ["g"]), "t") == [(0.5,), (1.5,)]


def test_prior_cue_near_bucket_edges(spark):
    """Boundaries just below and above whole and half seconds, against every pair by plain Python."""
    times = [0.0, 0.494, 0.4951, 0.5, 0.996, 1.4929, 1.498, 1.51, 2.0, 123.4951]
    ends = [k / 2 + d for k in (0, 1, 2, 3, 4, 5, 248) for d in (-0.011, -0.01, -0.005, -0.0049, -0.001, 0.0, 0.005, 0.3)] + [0.995]
    bounds = spark.createDataFrame([("a", i, e, i % 2 == 0) for i, e in enumerate(ends)] + [("a", 999, None, True)], "g string, id int, boundary double, major boolean")
    grid = [("a", ("beat", "section")[i % 3 == 1], t) for i, t in enumerate(times)]
    want = []
    for i, e in enumerate(ends):
        found = [(kind != "section", -t, kind) for _, kind, t in grid if t <= e + 0.01 and e - t <= 0.5 and (i % 2 == 0 or kind == "beat")]
        want.append((i, *((min(found)[2], -min(found)[1]) if found else ("-", -1.0))))
    got = cues.prior_cue(bounds, spark.createDataFrame(grid, "g string, kind string, t double"), ["g"])
    assert rows(got.fillna({"kind": "-", "cue": -1.0}), "id", "kind", "cue") == [*want, (999, "-", -1.0)]


def test_snapping(spark):
    kind = "g int, ord bigint, source string, start double, stop double, base double"
    lines = spark.createDataFrame([(1, [float(i) for i in range(20)], [0.0, 8.0], [0.0])], "g int, beats array<double>, phrases array<double>, sections array<double>")
    same = spark.createDataFrame([(1, 0, "a", 0.0, 5.4, 0.5), (1, 1, "a", 6.0, 9.0, 0.5)], kind)
    assert rows(cues.snap(same, lines, ["g"]), "ord", "snapped", "cue") == [(0, 5.0, "beat"), (1, 9.0, "")]
    major = spark.createDataFrame([(1, 0, "a", 0.0, 8.3, 0.5), (1, 1, "b", 6.0, 9.0, 0.5)], kind)
    assert rows(cues.snap(major, lines, ["g"]), "ord", "snapped", "cue") == [(0, 8.0, "phrase"), (1, 9.0, "")]


def test_snapping_streams_groups_over_batches(spark):
    """Groups over several Arrow batches, with and without cues, a null time and null keys, against a plain loop."""
    data, end = [], {}
    for g in range(5):
        data += [(g, k, "ab"[(k + g) % 4 == 0], 50.0 * k, 50.0 * k + (24.3, 3.0, 3.3, *[(5 * k + 3 * g) % 11 * 0.53 + 1.2] * 10)[k], k % 3 * 0.2) for k in range(13 - 3 * g)]
    data[20] = (*data[20][:4], None, 0.1)
    odd = [(None, 0, "a", 0.0, 5.0, 0.5), (1, None, "a", 0.0, 5.0, 0.5)]
    seg = spark.createDataFrame(data[::-1] + odd, "g int, ord bigint, source string, start double, stop double, base double")
    beats = [i * 0.75 for i in range(200)]
    want = []
    for i, (g, k, source, start, stop, base) in enumerate(data):
        line, after = end.get(g, 0.0) if k else 0.0, data[i + 1] if i + 1 < len(data) and data[i + 1][0] == g else None
        moved, kind = None, ""
        if line is not None and stop is not None and after is not None:
            for name, n in (("section", 32), ("phrase", 8), ("beat", 1)):
                near = [t for t in beats[::n] if t <= line + (stop - start) + 0.01 and line + (stop - start) - t <= 0.5]
                if near and (n == 1 or source != after[2] or abs(base - after[5]) >= 0.25):
                    moved, kind = (near[-1] - line, name) if near[-1] - line >= 1 else (None, "")
                    break
        end[g] = None if line is None or stop is None else line + (stop - start if moved is None else moved)
        want.append((g, k, source, stop if moved is None else start + moved, kind))
    lists = spark.createDataFrame([(g, beats[::-1], beats[::8], beats[::32]) for g in (0, 1, 2, 4, 9, None)], "g int, beats array<double>, phrases array<double>, sections array<double>")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        assert {kind for *_, kind in want} == {"", "beat", "phrase", "section"}
        assert rows(cues.snap(seg, 0.75, ["g"]), "g", "ord", "source", "snapped", "cue") == want
        bare = [(*w[:3], d[4], "") if w[0] == 3 else w for w, d in zip(want, data, strict=True)]
        assert rows(cues.snap(seg, lists, ["g"]), "g", "ord", "source", "snapped", "cue") == bare
    finally:
        spark.conf.unset(size)


def test_transitions_keep_the_rules(spark):
    kind = "g int, ord bigint, source string, start double, stop double, cue string"
    frame = spark.createDataFrame([(1, 0, "a", 0.0, 4.0, ""), (1, 1, "b", 0.0, 4.0, "section"), (1, 2, "b", 5.0, 9.0, ""), (1, 3, "c", 0.0, 0.5, ""), (1, 4, "d", 0.0, 4.0, ""), (2, 0, "a", 0.0, 0.4, "")], kind)
    planned = segments.plan_transitions(frame, ["g"], "ord")
    assert rows(planned, "g", "ord", "transition", "transition_seconds") == [(1, 0, "fade", 0.5), (1, 1, "dissolve", 0.15), (1, 2, "cut", 0.0), (1, 3, "cut", 0.0), (1, 4, "cut", 0.0), (2, 0, "cut", 0.0)]
    assert segments.transition_violation(planned, ["g"], "ord").filter("violation IS NOT NULL").count() == 0
    line = segments.timeline(planned.filter("g = 1"), ["g"], "ord")
    assert [round(r.offset, 6) for r in line.orderBy("ord").collect()] == [0.0, 3.85, 7.85, 11.85, 12.35]


def test_speech_and_continuity(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 6.0), (1, 1, 0.0, 6.0)], "g int, ord bigint, start double, stop double")
    spans = spark.createDataFrame([(1, o, s, s + 2.0) for o in (0, 1) for s in (0.0, 2.0, 4.0)], "g int, ord bigint, s double, e double")
    assert rows(segments.continuity(seg, spans, ["g"], "ord"), "from_segment", "to_segment", "kind", "seconds") == [(0, 1, "L-cut", 0.75)]


def test_trim_and_overlaps(spark):
    seg = spark.createDataFrame([(1, 0, "a", 0.0, 2.0), (1, 1, "a", 2.0, 5.0), (1, 2, "a", 4.0, 6.0)], "g int, ord bigint, source string, start double, stop double")
    assert rows(segments.trim_to_budget(seg, ["g"], "ord", F.lit(3.0)), "ord", "trimmed") == [(0, 2.0), (1, 3.0)]
    assert rows(segments.overlaps(seg, ["g"]), "start", "before_stop") == [(4.0, 5.0)]


def test_scalars(spark):
    think = ["a <think>b</think> c", "<think>x", "plain", "<think>a</think><think>b</think>z", "x<think>y"]
    assert [one(spark, S.strip_reasoning(F.lit(t)))[0] for t in think] == ["a  c", "", "plain", "z", "x"]
    assert one(spark, S.hardware_kbps(F.lit(1280), F.lit(720), F.lit(30)), S.hardware_kbps(F.lit(320), F.lit(240), F.lit(24)), S.kbps(F.lit("2800k")), S.kbps(F.lit("k"))) == (2765, 2000, 2800, 0)
    assert one(spark, *S.display_size(F.lit(1920), F.lit(1080), F.lit(-90))) == (1080, 1920)
    assert one(spark, S.round_ms(F.lit(0.7504999)), S.fixed_seconds(F.lit(1.5)), S.escape_filter(F.lit("a:b c'")), S.first_line(F.lit("\n x\ny"))) == (0.75, "1.500000", "a\\:b\\ c\\'", "x")
    key = lambda c, m, s: one(spark, S.memo_key(F.lit(c), F.lit(m), F.create_map(*[F.lit(x) for p in s for x in p])))[0]
    a = key("x", "f", [("a", "1"), ("b", "2")])
    assert a == key("x", "f", [("b", "2"), ("a", "1")]) and len({a, key("y", "f", [("a", "1"), ("b", "2")]), key("x", "g", [("a", "1"), ("b", "2")]), key("x", "f", [("a", "2"), ("b", "2")])}) == 4
    small, big, same = (one(spark, S.fingerprint(F.lit(b), 4))[0] for b in (b"abc", b"abcdefghij", b"abcdXXghij"))
    assert small.startswith("v1:3:") and big.startswith("v1:10:") and big == same  # only the first and last four bytes count


def test_memo_and_problems(spark):
    plan = spark.createDataFrame([("a", "m", 0.0, 1.0), ("b", "m", 0.0, 1.0), ("c", "", 0.0, 1.0), ("d", "m", 1.0, 1.0), ("e", "m", 0.0, 1.0)], "source string, mark string, start double, stop double")
    now = spark.createDataFrame([("a", "m"), ("b", "n"), ("d", "m")], "source string, mark string")
    assert [p for _, p in rows(memo.source_problems(plan, now).fillna({"problem": "-"}), "source", "problem")] == ["-", "source changed", "missing a source fingerprint", "empty range", "source is missing"]
    wanted = spark.createDataFrame([("k1",), ("k2",)], "key string")
    known = spark.createDataFrame([("k1", 7), ("k2", None)], "key string, value int")
    assert rows(memo.split_work(wanted, known), "key", "hit") == [("k1", True), ("k2", False)]
    text = spark.createDataFrame([("f", "V..= \n x = legend\n T.. overlay Overlay.\nshort\n")], "kind string, raw string")
    assert rows(memo.capability_names(text), "name") == [("overlay",)]


def test_documents(spark, tmp_path):
    paths = spark.createDataFrame([("d/a.MP4",), ("d/.b.mp4",), ("d/c.txt",), ("d/e",), ("d/x.mov",)], "path string")
    got = documents.split_listing(paths, spark.createDataFrame([("d/x.mov",)], "path string"))
    assert rows(got.fillna({"reason": "-"}), "path", "reason") == [("d/a.MP4", "-"), ("d/c.txt", "unsupported file type"), ("d/e", "unsupported file type")]
    doc = json.dumps({"streams": [{"width": 1920, "height": 1080, "color_transfer": "smpte2084", "tags": {"rotate": "90"}, "side_data_list": []}], "format": {"duration": "6.0", "tags": {"creation_time": "2026-01-01T10:00:00Z"}}})
    probes = spark.createDataFrame([("a", doc), ("b", "corrupt")], "path string, json string").withColumn("mtime", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert rows(documents.parse_probe(probes).fillna({"reason": "-", "width": 0}), "path", "width", "hdr", "reason") == [("a", 1080, True, "-"), ("b", 0, False, "unreadable probe")]
    speech = json.dumps({"result": {"language": "en"}, "transcription": [{"offsets": {"from": 0, "to": 2000}, "text": " one "}, {"offsets": {"from": 2000, "to": 2000}, "text": "x"}]})
    assert rows(documents.parse_transcript(spark.createDataFrame([("a", 1.0, speech)], "path string, start double, json string")), "s", "e", "text") == [(1.0, 3.0, "one")]
    catalogue = json.dumps({"models": [{"type": "llm", "key": "k", "capabilities": {"vision": True}}, {"type": "llm", "key": "n", "capabilities": {"vision": False}}]})
    assert rows(documents.vision_models(spark.createDataFrame([(catalogue,)], "json string")), "key") == [("k",)]
    plan = spark.createDataFrame([("1", "chronological", [("a", "m", 0.0, 1.0, "cut")])], documents.PLAN)
    documents.write_plan(plan, f"{tmp_path}/plan")
    assert documents.read_plan(spark, f"{tmp_path}/plan").first() == plan.first()
    with pytest.raises(Exception, match="(?i)exist"):
        documents.write_plan(plan, f"{tmp_path}/plan")
    documents.write_plan(plan.withColumn("version", F.lit("2")), f"{tmp_path}/plan", force=True)
    with pytest.raises(Exception, match="not a plan"):
        documents.read_plan(spark, f"{tmp_path}/plan").collect()


def test_a_group_without_any_score_is_an_error(spark):
    rows_ = spark.createDataFrame([(1, 0.5), (1, None), (2, None), (2, None)], "g long, score double")
    assert {(r.score, r.reason) for r in ranking.divert_unscored(rows_.filter("g = 1"), ["g"]).collect()} == {(0.5, None), (None, "unscorable response")}
    with pytest.raises(Exception, match=r"every candidate segment failed scoring \(2 of 2\)"):
        ranking.divert_unscored(rows_, ["g"]).collect()


def test_relative_paths(spark):
    cases = [("/a/b", "/a/c", "../c"), ("/a/b", "/a/b", "."), ("/a/b", "/a/b/c/d", "c/d"), ("/a/b/c", "/", "../../.."), ("/", "/x", "x"), ("a", "b", "../b"), ("/a", "b", "b"), ("a//b/./", "a/b/c", "c")]
    frame = spark.createDataFrame(cases, "folder string, target string, want string")
    assert [r.got == r.want for r in frame.select("want", settings.relative_path(frame.folder, frame.target).alias("got")).collect()] == [True] * len(cases)


def test_memo_entries_are_appended(spark, tmp_path):
    one = spark.createDataFrame([("a", "k1", 1), ("b", "k2", 2)], "category string, key string, value long")
    memo.append_entries(one, f"{tmp_path}/memo")
    known = spark.read.parquet(f"{tmp_path}/memo")
    memo.append_entries(memo.new_entries(one.union(spark.createDataFrame([("a", "k3", 3)], one.schema)), known), f"{tmp_path}/memo")
    assert sorted((r.category, r.key, r.value) for r in spark.read.parquet(f"{tmp_path}/memo").collect()) == [("a", "k1", 1), ("a", "k3", 3), ("b", "k2", 2)]
