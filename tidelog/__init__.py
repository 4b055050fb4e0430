"""tidelog: keyed, versioned tables on Spark.

Batches of upserts and deletes form a change log; every read keeps the newest version of each key and
then drops deletions.  See :class:`tidelog.table.Table` for the stored table and
:mod:`tidelog.operators` for the plans over any change-log DataFrame.
"""

from tidelog.model import CHANGE_LOG, STATE, KeyRange
from tidelog.table import Table

__all__ = ["CHANGE_LOG", "STATE", "KeyRange", "Table"]
