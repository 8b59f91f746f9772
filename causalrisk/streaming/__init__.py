from causalrisk.streaming.history import event_history, stream_history
from causalrisk.streaming.scoring import Scorer, read_files, run_available

__all__ = ["Scorer", "event_history", "read_files", "run_available", "stream_history"]
