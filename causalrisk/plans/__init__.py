from causalrisk.plans.ingest import ingest
from causalrisk.plans.investigate import build_cases, investigate
from causalrisk.plans.train import build_features, calibrate_and_test, train_models

__all__ = ["build_cases", "build_features", "calibrate_and_test", "ingest", "investigate", "train_models"]
