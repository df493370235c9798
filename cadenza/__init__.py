"""cadenza: catalogue quality, merge, similarity and scoring on Spark.

Every public function takes DataFrames (and column names) and returns a
DataFrame; nothing is collected to the driver on a data path.
"""

from cadenza.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
