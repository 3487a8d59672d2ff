"""calibra: calibration and evaluation-audit analytics on Spark.

Table-in / table-out operators over response logs of any size: parsing and
scoring of model replies, expected calibration error, reliability bins,
regression / rank tests, bootstrap intervals, Holm correction, stratified
bank building, collection plans with resume, spend ledgers, integrity
reports and streaming drift monitors.  Everything is expressed with the
DataFrame API so Catalyst plans it and the cluster scales it.
"""

from calibra.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
