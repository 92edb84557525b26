"""File formats on small hand-made files."""

import io
import json
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from skirmish.sources import battles, filenames, manifest, results, teams, trajectories, usage

REPORT = """ +----------------------------------------+
 | Alpha One                              |
 +----------------------------------------+
 | Raw count: 120                         |
 | Avg. weight: 0.51                      |
 +----------------------------------------+
 | Abilities                              |
 | Fast Feet 75.500%                      |
 | Other 24.500%                          |
 +----------------------------------------+
 | Spreads                                |
 | Bold:252/0/4/0/0/252 11.000%           |
 +----------------------------------------+
 | Teammates                              |
 | Beta +12.345%                          |
 +----------------------------------------+
 | Checks and Counters                    |
 | Gamma Ray 62.500 (80.25±9.12)          |
 |   (5.0% KOed / 11.0% switched out)     |
 +----------------------------------------+
 +----------------------------------------+
 | Beta                                   |
 +----------------------------------------+
 | Raw count: 7                           |
 +----------------------------------------+
 | Tera Types                             |
 | Fire 100.000%                          |
 +----------------------------------------+
"""


def test_usage_report(spark, tmp_path):
    (tmp_path / "gen1ou-1500.txt").write_text(REPORT)
    share, counts = usage.parse_reports(usage.read_reports(spark, [str(tmp_path)]), ["path"])
    got = {(r["entity"], r["field"], r["key"]): r["share"] for r in share.collect()}
    assert got == {("Alpha One", "abilities", "Fast Feet"): 0.755, ("Alpha One", "abilities", "Other"): 0.245,
                   ("Alpha One", "spreads", "Bold:252/0/4/0/0/252"): 0.11, ("Alpha One", "teammates", "Beta"): 0.12345,
                   ("Alpha One", "checks", "Gamma Ray"): 0.625, ("Alpha One", "tera_types", "Nothing"): 1.0,
                   ("Beta", "tera_types", "Fire"): 1.0}
    assert {r["entity"]: r["n"] for r in counts.collect()} == {"Alpha One": 120, "Beta": 7}


def test_reports_are_split_once(spark, tmp_path, monkeypatch):
    stored = []
    kept = usage.materialise
    monkeypatch.setattr(usage, "materialise", lambda df, label: stored.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label))
    (tmp_path / "gen1ou-1500.txt").write_text(REPORT)
    usage.parse_reports(usage.read_reports(spark, [str(tmp_path)]), ["path"])
    assert len(stored) == 2 and "posexplode" in stored[0] and "posexplode" not in stored[1]


def test_report_rank(spark):
    names = ["gen1ou.txt", "gen1ou-1760.txt", "gen1ou-1630.5.txt", "gen1ouextra.txt", "gen1ou-0.txt.gz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(usage.report_rank(F.col("n"), F.lit("gen1ou"))).collect()] == [1500, 1760, 1630, None, None]


def test_team_file(spark, tmp_path):
    (tmp_path / "x.gen3ou_team").write_text(
        "Nick (Aaa) (M) @ Leftovers\nAbility: No Ability\nEVs: 252 HP / 4 Spe\nBold Nature\n- One / Two\n- Three\n\nBbb (F)\n- Four\n")
    rows = teams.parse_teams(teams.read_team_files(spark, [str(tmp_path)]), ["path"]).orderBy("slot").collect()
    assert [(r["name"], r["item"], r["ability"], r["nature"], r["moves"]) for r in rows] == [
        ("Aaa", "Leftovers", "<none>", "Bold", ["One", "Three"]), ("Bbb", None, None, None, ["Four"])]
    assert rows[0]["evs"] == [252, None, None, None, None, 4] and rows[1]["evs"] is None


def test_result_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Player Username,Team File,Opponent Username,Result,Turn Count,Battle ID\n"
                                    "p1,/a/b/c,q,win,12,b1\n\np1,short,row\n")
    (tmp_path / "b.csv").write_text("p2,/a/b/c,q,LOSS\n")
    rows = results.read_result_csv(spark, [str(tmp_path)]).orderBy("player").collect()
    assert [(r["player"], r["result"], r["turns"], r["battle_id"]) for r in rows] == [
        ("p1", "WIN", 12, "b1"), ("p2", "LOSS", None, None)]


def test_raw_battles_with_a_broken_file(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    good = {"id": "gen1ou-1", "format": "MISSING", "players": ["x", "y"], "log": "|turn|1", "uploadtime": 5}
    (a / "1.json").write_text(json.dumps(good, indent=1))
    (b / "1.json").write_text(json.dumps(good))
    (b / "2.json").write_text('{"id": "gen1ou-2", "log"')
    ok, bad = battles.read_raw_battles(spark, [str(a), str(b)])
    assert ok.count() == 1 and bad.count() == 1
    assert battles.recover_format(ok).first()["format_id"] == "gen1ou"


def test_archives(spark, tmp_path):
    state = {"format": "gen1ou", "forced_switch": False, "weather": "noweather"}
    body = json.dumps({"states": [state, state], "actions": [3, -1]}).encode()
    packed = pa.compress(body, codec="lz4", asbytes=True)
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for n, data in (("a.json", body), ("b.json", body), ("c.json.lz4", packed), ("d.json.lz4", b"no frame"),
                        ("e.json", body[:-3]), ("f.txt", b"x")):
            info = tarfile.TarInfo(f"in/{n}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "y.tar").write_bytes(b"not an archive at all")
    (tmp_path / "single.json.lz4").write_bytes(packed)
    steps = trajectories.to_steps(trajectories.read_trajectory_archives(spark, [str(tmp_path)]), ["file_name"])
    assert steps.count() == 6
    for n in ("a.json", "c.json.lz4"):
        assert [r["action"] for r in steps.where(f"file_name = '{n}'").orderBy("t").collect()] == [3, -1]
    wrong = trajectories.archive_members(spark, [str(tmp_path)]).where("error IS NOT NULL").collect()
    assert {r.file_name for r in wrong} == {"d.json.lz4", "e.json", None}
    single = trajectories.parsed(trajectories.compressed_files(spark, [str(tmp_path)])).collect()
    assert [(r.file_name, r.actions) for r in single] == [("single.json.lz4", [3, -1])]


def test_names_and_manifest(spark, tmp_path):
    names = ["b_1500_al_vs_bo_01-02-2020_WIN.json", "b_1500_a_l_vs_bo_01-02-2020-10:11:12_LOSS.json.lz4", "b_1_x.json"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    rows = filenames.parse_trajectory_names(df).orderBy("player").collect()
    assert [(r["player"], r["result"], str(r["played"])) for r in rows] == [
        ("a_l", "LOSS", "2020-01-02 10:11:12"), ("al", "WIN", "2020-01-02 00:00:00")]
    (tmp_path / "one.txt").write_text("1")
    listing = manifest.list_files(spark, str(tmp_path))
    assert manifest.read_manifest(spark, str(tmp_path / "none"), str(tmp_path)).count() == 1
    assert manifest.unseen(listing, listing.where("file_name = 'x'")).count() == 1


def test_archives_in_stretches(spark, tmp_path):
    """Written archives roll, one archive is read by several tasks, and the members before a cut survive."""
    bodies = spark.range(300).select(F.concat(F.lit("f"), "id", F.when(F.col("id") % 2 == 0, ".json").otherwise(".json.lz4")).alias("file_name"),
                                     F.to_json(F.struct("id", F.repeat(F.lit("x"), 900).alias("pad"))).alias("body"))
    made = trajectories.write_archives(bodies.coalesce(2), str(tmp_path / "out"), roll_bytes=60_000)
    assert made.count() > 3 and made.agg(F.sum("members")).first()[0] == 300
    index = trajectories.archive_index(made)
    got = trajectories.archive_bodies(index, target=8192)
    assert got.join(bodies, ["file_name", "body"]).count() == 300 and got.where("error IS NOT NULL").count() == 0
    whole = made.first()["archive"]
    data = open(whole, "rb").read()
    (tmp_path / "cut.tar").write_bytes(data[:len(data) // 2 - 300])
    left = trajectories.archive_members(spark, [str(tmp_path / "cut.tar")]).collect()
    good = [r for r in left if r.error is None]
    assert good and {r.file_name for r in good} <= {r.file_name for r in got.where(F.col("archive") == whole).collect()}
    assert any(r.error for r in left)
    assert trajectories.archive_index(made.where("1 = 0")).count() == 0
