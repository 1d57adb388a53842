"""ranklane: learning-to-rank data work expressed as Spark DataFrame jobs.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver except bounded scalars
(hyper-parameters, a chosen step size, model weights bounded by
features x domains).
"""

from ranklane.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
