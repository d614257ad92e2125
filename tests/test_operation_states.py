"""What the states of operations carry through their sorts."""

from parlance import catalog
from parlance.functions import ordered
from parlance.operators import audit


def test_states_carry_no_text_of_the_log(spark, monkeypatch):
    """Module, endpoint and summary of a call are in no result, so no scan sorts or writes them."""
    seen = []

    def noted(module):
        real = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(set(df.columns)), real(df))[1])

    noted(ordered)
    noted(audit)
    states = catalog.queries()["a1_operation_states"](spark, "/root/testdata/sf0.001")
    calls = [columns for columns in seen if "provider_error" in columns]
    assert calls and not any({"module", "endpoint", "summary"} & columns for columns in calls)
    assert states.columns == ["operation_id", "workspace_id", "n_openings", "n_refused", "n_attempted", "n_blocked", "state"]
