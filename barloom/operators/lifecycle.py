"""Strategy lifecycle: transition requests checked against a table of rules, accepted ones appended to a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: State -> states that may follow
FOLLOWS = {
    "RESEARCH": "BACKTESTED REJECTED DISABLED", "BACKTESTED": "VALIDATING REJECTED DISABLED", "VALIDATING": "CANDIDATE REJECTED DISABLED", "CANDIDATE": "PAPER REJECTED DISABLED",
    "PAPER": "APPROVED UNDER_REVIEW REJECTED DISABLED", "APPROVED": "ACTIVE UNDER_REVIEW DISABLED", "ACTIVE": "DEGRADED UNDER_REVIEW DISABLED", "DEGRADED": "UNDER_REVIEW DISABLED ACTIVE",
    "UNDER_REVIEW": "DISABLED PAPER ACTIVE REJECTED", "DISABLED": "UNDER_REVIEW", "REJECTED": "RESEARCH",
}
#: States only a person may set, actors that are none, and what a state needs as evidence
HUMAN_ONLY = ("APPROVED", "ACTIVE")
MACHINES = ("ai", "evolution", "system")
EVIDENCE = {
    "BACKTESTED": ["backtest_experiment_id"], "CANDIDATE": ["walk_forward_experiment_id", "robustness_passed", "oos_experiment_id", "monte_carlo_experiment_id"], "APPROVED": ["paper_trading_report_id"],
}


def rules(spark: SparkSession) -> DataFrame:
    """from_status, to_status, needs: a table of a few dozen rows."""
    return spark.createDataFrame([(a, b, EVIDENCE.get(b, [])) for a, bs in FOLLOWS.items() for b in bs.split()], "from_status string, to_status string, needs array<string>")


def status(history: DataFrame) -> DataFrame:
    """strategy_id, status: the latest of each strategy's history (strategy_id, seq, to_status)."""
    return history.groupBy("strategy_id").agg(F.max_by("to_status", "seq").alias("status"))


def judge(requests: DataFrame, history: DataFrame) -> DataFrame:
    """requests (strategy_id, to_status, actor, evidence array of the keys that are given) with from_status, allowed, problem."""
    rows = requests.join(status(history).withColumnRenamed("status", "from_status"), "strategy_id", "left").join(F.broadcast(rules(requests.sparkSession)), ["from_status", "to_status"], "left")
    missing = F.array_except("needs", F.coalesce("evidence", F.array().cast("array<string>")))
    problem = F.when(F.col("from_status").isNull(), "unknown strategy").when(F.col("needs").isNull(), "not allowed").when(F.col("to_status").isin(*HUMAN_ONLY) & F.col("actor").isin(*MACHINES), "needs a human").when(F.size(missing) > 0, F.concat(F.lit("missing evidence: "), F.concat_ws(", ", F.array_sort(missing))))
    return rows.select("strategy_id", "from_status", "to_status", "actor", problem.isNull().alias("allowed"), problem.alias("problem"))


def apply(requests: DataFrame, history: DataFrame) -> DataFrame:
    """history with the allowed requests appended; of several requests for a strategy the first in order of to_status counts."""
    one = judge(requests, history).where("allowed").withColumn("_k", F.row_number().over(Window.partitionBy("strategy_id").orderBy("to_status"))).where("_k = 1")
    last = history.groupBy("strategy_id").agg((F.max("seq") + 1).alias("seq"))
    return history.select("strategy_id", "seq", "from_status", "to_status", "actor").unionByName(one.join(last, "strategy_id").select("strategy_id", "seq", "from_status", "to_status", "actor"))


def by_status(history: DataFrame) -> DataFrame:
    return status(history).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
