"""Command line: audit over a directory of per-model JSONL logs; dry run."""
import json
import os
import tempfile

from calibra.__main__ import main
from calibra.sources import fixtures as FX
from tests.conftest import SF001


def test_cli_audit_from_jsonl_logs(spark, capsys):
    d = tempfile.mkdtemp(prefix="calibra-cli-", dir="/tmp")
    raw = FX.raw_responses(spark, SF001).drop("l_linenumber", "l_discount", "answer_index")
    pdf = raw.toPandas()
    pdf["collection_timestamp"] = pdf["collection_timestamp"].astype(str)
    for m, part in pdf.groupby("model_id"):
        with open(os.path.join(d, f"{m}_S1.jsonl"), "w") as f:
            for rec in part.to_dict("records"):
                f.write(json.dumps({k: (None if v != v else v) for k, v in rec.items()}) + "\n")
    out = os.path.join(d, "out")
    assert main(["audit", "--jsonl-dir", d, "--stamp", "S1", "--models", "R", "A", "N",
                 "--out", out, "--n-bootstrap", "100"]) == 0
    meta = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert meta["n_raw"] == len(pdf)
    overall = spark.read.parquet(os.path.join(out, "overall_by_model")).collect()
    assert sorted(r.model_id for r in overall) == ["A", "N", "R"]


def test_cli_dry_run(spark, capsys):
    d = tempfile.mkdtemp(prefix="calibra-cli-", dir="/tmp")
    p = os.path.join(d, "bank.json")
    with open(p, "w") as f:
        json.dump([{"question_id": f"q{i:04d}", "subject": "sociology"} for i in range(540)], f)
    assert main(["dry-run", "--bank", p, "--models", "claude_haiku", "gpt4o_mini", "gemini_flash",
                 "--trials", "5"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")]
    total = [r for r in rows if r["model_id"] == "TOTAL"][0]
    assert total["calls"] == 8100 and round(total["est_cost_usd"], 2) == 2.86
