"""tabforge — tabular feature engineering and classification on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames. Work is expressed with
built-in Catalyst expressions, aggregates, joins and windows so the optimizer
can push filters and prune columns down to the scan; nothing data-sized is
collected to the driver.
"""

from tabforge.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
