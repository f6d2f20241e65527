"""The model queries train the production model, of the reference's size."""

from ledgerflow.plans import queries
from ledgerflow.plans.contract import Config


def test_model_queries_use_production_settings():
    assert queries.MODEL == Config()
    assert (Config().boosting_rounds, Config().boosting_depth, Config().boosting_step, Config().isolation_trees) == (300, 6, 0.05, 300)
