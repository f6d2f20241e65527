"""explain_shap asks for every account of the scored part."""

from types import SimpleNamespace

from ledgerflow.operators import explain
from ledgerflow.plans import queries, reports


def test_explain_shap_asks_for_all_accounts(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_run", lambda spark, sf_dir: SimpleNamespace(features="features", artifacts="artifacts", scored="scored"))
    monkeypatch.setattr(reports, "alert_feed", lambda *args, **named: "some")
    monkeypatch.setattr(explain, "explain_shap", lambda features, artifacts, accounts=None, top_k=7: asked.append((features, accounts)))
    monkeypatch.setattr(queries, "tidy", lambda df: df)
    queries.explain_shap(None, "")
    assert asked == [("features", None)]
