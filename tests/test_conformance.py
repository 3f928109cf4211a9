"""The conformance corpus, read as data from the folder that CONFORMANCE_CORPUS names."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from pactlake.functions import numbers
from pactlake.operators.evaluate import evaluate
from pactlake.operators.flags import compiled
from pactlake.plans.catalog import Catalog

CORPUS = Path(os.environ.get("CONFORMANCE_CORPUS", "no-corpus"))
DRAFTS = {"draft4": "http://json-schema.org/draft-04/schema", "draft6": "http://json-schema.org/draft-06/schema", "draft7": "http://json-schema.org/draft-07/schema", "draft2019-09": "https://json-schema.org/draft/2019-09/schema", "draft2020-12": "https://json-schema.org/draft/2020-12/schema"}
#: Content keywords are asserted here, unlike in the corpus; and files outside the core of a draft.
SKIP_GROUPS = {"validation of string-encoded content based on media type", "validation of binary string-encoding", "validation of binary-encoded media type documents", "validation of binary-encoded media type documents with schema"}
FILES = [p for d in DRAFTS for p in sorted((CORPUS / "tests" / d).rglob("*.json"))] if CORPUS.exists() else []


def catalog_for(draft: str, assert_format: bool) -> Catalog:
    own = Catalog(default_dialect=DRAFTS[draft], assert_format=assert_format, on_unresolved="ignore")

    def remote(uri: str) -> str:
        path = CORPUS / "remotes" / uri.removeprefix("http://localhost:1234/")
        if not path.is_file():
            raise KeyError(uri)
        return path.read_text()

    own.register_loader("http", remote)
    return own


def failures(path: Path) -> list[str]:
    draft = path.relative_to(CORPUS / "tests").parts[0]
    bad = []
    for group in numbers.parse(path.read_text()):
        if group["description"] in SKIP_GROUPS:
            continue
        try:
            node = catalog_for(draft, "optional/format" in str(path)).compile(group["schema"])
        except Exception as e:
            bad.append(f"{group['description']}: {type(e).__name__} {e}")
            continue
        for case in group["tests"]:
            try:
                got = evaluate(node, case["data"]).valid
                if compiled(node)(case["data"]) != got:
                    got = f"the closures differ from {got}"
            except Exception as e:
                got = f"{type(e).__name__} {e}"
            if got != case["valid"]:
                bad.append(f"{group['description']} / {case['description']}: {got}")
    return bad


@pytest.mark.skipif(not FILES, reason="no corpus on this machine")
@pytest.mark.parametrize("path", FILES, ids=[str(p.relative_to(CORPUS / "tests")) for p in FILES])
def test_file(path: Path) -> None:
    name = str(path.relative_to(CORPUS / "tests"))
    known = json.loads((Path(__file__).parent / "known_differences.json").read_text()).get(name, [])
    assert sorted(b for b in failures(path) if not any(b.startswith(k) for k in known)) == []


def test_both_tiers_give_one_list(spark) -> None:
    """Validity and (path, keyword, code, message) of every case that has a native plan, in both tiers."""
    from pactlake.operators.contract import Contract

    rows, wanted = {}, {}
    for path in FILES:
        draft = path.relative_to(CORPUS / "tests").parts[0]
        if "optional" in str(path) and "format" not in str(path) or draft not in ("draft7", "draft2020-12"):
            continue
        for g, group in enumerate(numbers.parse(path.read_text())):
            if group["description"] in SKIP_GROUPS:
                continue
            texts = [numbers.dumps(c["data"]) for c in group["tests"]]
            df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
            try:
                contract = Contract(catalog_for(draft, "optional/format" in str(path)).compile(group["schema"]))
                if contract.tier_for(df, "s") != "native":
                    continue
            except Exception:
                continue
            rows[f"{path.relative_to(CORPUS)}/{g}"] = (contract, texts)
    assert len(rows) > 100
    # One frame for many contracts: a job for each would take hours.
    names = sorted(rows)
    for at in range(0, len(names), 40):
        some = names[at : at + 40]
        most = max(len(rows[n][1]) for n in some)
        df = spark.createDataFrame([(i, *[rows[n][1][i] if i < len(rows[n][1]) else "null" for n in some]) for i in range(most)], ", ".join(["i int", *[f"t{k} string" for k in range(len(some))]])).coalesce(1)
        made = df.select("i", *[x for k, n in enumerate(some) for x in (rows[n][0].is_valid(df, f"t{k}").alias(f"v{k}"), rows[n][0].errors(df, f"t{k}").alias(f"e{k}"))]).collect()
        for r in made:
            for k, n in enumerate(some):
                if r.i < len(rows[n][1]):
                    want = evaluate(rows[n][0].node, numbers.parse(rows[n][1][r.i]))
                    own = [(p, e.keyword, e.code, e.message()) for p, e in want.flat()] if not want.valid else []
                    wanted[n, r.i] = ((r[f"v{k}"], [tuple(e) for e in r[f"e{k}"]]), (want.valid, own))
    assert {k: v for k, v in wanted.items() if v[0] != v[1]} == {}


test_both_tiers_give_one_list = pytest.mark.skipif(not FILES, reason="no corpus on this machine")(test_both_tiers_give_one_list)
