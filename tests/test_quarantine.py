"""Programs that fail on some peptide, and limits of what runs at once."""

import stat
import sys
import time
from pathlib import Path

import pytest

from epitrail.operators.quarantine import bisected
from epitrail.predictors import tools
from epitrail.predictors.tools import ToolPredictor, limited, one_of


def test_bisection_finds_all_and_loses_none():
    for bad in (set(), {0}, {99}, {3, 4, 50}, {7, 8, 9, 10, 77}):
        calls = []

        def attempt(items, bad=bad, calls=calls):
            calls.append(len(items))
            if bad & set(items):
                raise ValueError("no")
            return list(items)

        got = list(bisected(list(range(100)), attempt))
        assert [x for items, _, _ in got for x in items] == list(range(100))
        assert {items[0] for items, _, reason in got if reason} == bad and all(result == items for items, result, reason in got if not reason)
        assert len(calls) <= 1 + 2 * 7 * max(1, len(bad))


def test_faults_that_are_no_items():
    def missing(items):
        raise FileNotFoundError("no program")

    def down(items):
        calls.append(1)
        raise RuntimeError("no license")

    with pytest.raises(FileNotFoundError):
        list(bisected([1, 2, 3], missing))
    calls = []
    with pytest.raises(RuntimeError, match="license"):
        list(bisected(list(range(10_000)), down, patience=40))
    assert len(calls) == 40
    calls = []
    assert len(list(bisected(list(range(64)), down))) == 64 and len(calls) == 127  # a whole batch at fault
    calls = []
    assert [r for _, _, r in bisected([1], down)] == ["RuntimeError: no license"]


PROGRAM = f"""#!{sys.executable}
import sys
args = sys.argv[1:]
rows = [x.strip() for x in open(args[args.index("-f") + 1])]
allele = args[args.index("-a") + 1]
if any(p.startswith("KKK") for p in rows):
    sys.exit(3)
if any(p.endswith("YYY") and allele.startswith("HLA-B") for p in rows):
    print("Error: cannot read a peptide")
print("-" * 40)
print("Pos HLA Peptide Core Of Gp Gl Ip Il Icore Identity Score Aff(nM) %Rank BindLevel")
print("-" * 40)
for i, p in enumerate(rows):
    print(i + 1, allele, p, p, 0, 0, 0, 0, 0, p, "PEPLIST", 0.5, 100 + i, 1.5)
print("-" * 40)
"""


@pytest.fixture
def program(tmp_path):
    path = Path(tmp_path, "tool")
    path.write_text(PROGRAM)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_one_bad_peptide_does_not_fail_a_job(spark, program):
    good = [f"ACDEFGHI{a}" for a in "ACDEFGHIKLMNPQRSTVWY"]
    given = [*good[:7], "KKKAAAAAA", *good[7:], "AAAAAAYYY", "SHRT", "XACDEFGHI", "acdefghik"]
    made = ToolPredictor(spark, ["HLA-A*02:01", "HLA-B*07:02"], "netmhcpan3", program=program)
    rows, errors = made.predict_or_quarantine(given)
    scored = {(r.peptide, r.allele) for r in rows.collect()}
    assert scored == {(p, a) for p in good for a in ("HLA-A*02:01", "HLA-B*07:02")} | {("AAAAAAYYY", "HLA-A*02:01")}
    told = {(r.peptide, r.allele): r.reason for r in errors.collect()}
    assert set(told) == {("KKKAAAAAA", "HLA-A*02:01"), ("KKKAAAAAA", "HLA-B*07:02"), ("AAAAAAYYY", "HLA-B*07:02"), ("SHRT", None), ("XACDEFGHI", None), ("acdefghik", None)}
    assert told["SHRT", None] == "too short" and "code 3" in told["KKKAAAAAA", "HLA-A*02:01"] and "cannot read" in told["AAAAAAYYY", "HLA-B*07:02"]
    assert rows.columns == made.predict(good).columns
    with pytest.raises(Exception, match="code 3"):
        made.predict(["KKKAAAAAA"]).collect()


def hold(name, limit, queue):
    with one_of(name, limit):
        queue.put(("in", time.time()))
        time.sleep(0.3)
        queue.put(("out", time.time()))


@pytest.mark.parametrize("limit", [1, 2])
def test_limit_of_processes_on_a_host(limit):
    import multiprocessing

    context = multiprocessing.get_context("fork")
    queue, name = context.Queue(), f"test{time.time()}"
    running = [context.Process(target=hold, args=(name, limit, queue)) for _ in range(4)]
    for p in running:
        p.start()
    events = sorted((queue.get(timeout=20) for _ in range(8)), key=lambda e: e[1])
    for p in running:
        p.join()
    now = most = 0
    for what, _ in events:
        now += 1 if what == "in" else -1
        most = max(most, now)
    assert most == limit


def test_profile_of_the_stage(spark, monkeypatch, program):
    assert tools.TOOLS["netmhc3"].limit == 1 and limited(spark, "netmhc3", 1) is None and limited(spark, "netmhcpan3", None) is None
    spark.conf.set("spark.executor.resource.netmhc3.amount", "1")
    try:
        frame = type(spark.range(0))
        seen, real = [], frame.mapInPandas
        monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema, barrier=False, profile=None: seen.append(profile) or real(self, f, schema))
        ToolPredictor(spark, "HLA-A*02:01", "netmhc3", program=program).predict(["ACDEFGHIK"])
        ToolPredictor(spark, "HLA-A*02:01", "netmhcpan3", program=program).predict(["ACDEFGHIK"])
    finally:
        spark.conf.unset("spark.executor.resource.netmhc3.amount")
    assert seen[0].taskResources["netmhc3"].amount == 1.0 and seen[1] is None
