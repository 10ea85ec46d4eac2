"""shelfcast: retail demand panels, baseline forecasts, inventory rules and
text datasets expressed as Spark DataFrame / SQL operators.

Every public function takes DataFrames (or a SparkSession plus a table
directory) and returns a lazy DataFrame; nothing is collected to the driver
except small, bounded parameter tables and counts.
"""

from shelfcast.session import get_session, ensure_checkpoint_dir, materialize

__all__ = ["get_session", "ensure_checkpoint_dir", "materialize"]
