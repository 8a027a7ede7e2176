"""The corpus pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir); its stages are part of the subpackage llm."""

from citegrain.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
