import collections
import re

import numpy as np
import pytest

from dishlens.llm import quality_rules as op


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    covered = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_equals_brute_force(both, rows):
    got = op.judge(both).collect()
    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[r.source].append(figures(r.text)[-1])
    n, k = sum(map(len, hosts.values())), len(hosts)
    mean = sum(map(sum, hosts.values())) / n
    scatter = sum(len(h) * (sum(h) / len(h) - mean) ** 2 for h in hosts.values())
    rho = (scatter / (mean * (1 - mean)) - (k - 1)) / (n - sum(len(h) ** 2 for h in hosts.values()) / n - (k - 1))
    weight = min(max(1 / rho - 1, 1.0), 1e6) if rho > 0 else 1e6
    shrunk = {s: (sum(h) + mean * weight) / (len(h) + weight) for s, h in hosts.items()}
    want = [(r.doc_id, *figures(r.text), round(shrunk[r.source], 4), not figures(r.text)[-1] and shrunk[r.source] <= op.MAX_HOST_RATE) for r in rows]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]
    have = [tuple(round(r[c], 4) if c == "host_rate" else r[c] for c in names) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_bad_hosts_lose_good_documents_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(200)]
    rows += [(1_000 + i, good, f"good{i % 20}") for i in range(400)] + [(5_000, "short", "tiny"), (5_001, good, "tiny")]
    got = {r.doc_id: r for r in op.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].base_failed and not got[0].kept
    assert got[1_000].kept and got[5_001].kept
    assert got[5_001].host_rate < 0.5


def test_tiny_hosts_do_not_weaken_the_prior(spark):
    """500 hosts of one document, a fifth failing, and a host of three with two failures, which keeps its good document."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short" if i % 5 == 0 else good, f"h{i}") for i in range(500)] + [(1_000, "short", "t"), (1_001, "short", "t"), (1_002, good, "t")]
    got = {r.doc_id: r for r in op.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1_002].kept and got[1_002].host_rate < 0.3
    assert all(got[i].kept == bool(i % 5) for i in range(500))


def test_prior_of_drawn_hosts(spark):
    """Failures drawn from hosts' rates that are drawn from a beta distribution give its parameters back."""
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 4_000)
    failed = rng.binomial(n, rng.beta(2, 6, 4_000))
    hosts = spark.createDataFrame([(str(i), int(a), int(b)) for i, (a, b) in enumerate(zip(n, failed, strict=True))], "host string, n long, failed long")
    a, b = op.beta_prior(hosts)
    assert a == pytest.approx(2, rel=0.15) and b == pytest.approx(6, rel=0.15)


def test_hosts_of_one_document_each_share_the_common_rate(spark):
    hosts = spark.createDataFrame([(str(i), 1, int(i % 4 == 0)) for i in range(40)], "host string, n long, failed long")
    assert sum(op.beta_prior(hosts)) == op.PRIOR_WEIGHT[1]
    assert op.beta_prior(hosts.where("failed = 0"))[0] == 0


def test_no_python_in_the_plan(both):
    plan = op.judge(both)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(odd):
    assert op.judge(odd.limit(0)).count() == 0


def test_prior_of_hosts_that_agree(spark):
    hosts = spark.createDataFrame([("a", 10, 1), ("b", 10, 1)], "host string, n long, failed long")
    a, b = op.beta_prior(hosts)
    assert a / (a + b) == pytest.approx(0.1) and a + b == op.PRIOR_WEIGHT[1]
