"""People analytics: pay, headcount, overtime, attendance, duplicates, productivity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.numeric import mean_of, rounded, without_nan
from gridlore.functions.schema import detect_roles
from gridlore.plans.quantiles import column_quantiles, quantiles
from gridlore.plans.shape import quoted, same_keys

# Fixed values of the rules.
MONTHLY_HOURS = 173
OVERTIME_RATE = 1.5
TOP_OVERTIME = 20
TOP_ATTENDANCE = 10
LISTED_DUPLICATES = 20
BEST, WORST = 10, 5


def salary_stats(df: DataFrame, salary: str = "salary") -> DataFrame:
    """One row: avg, median, min, max, range, std_dev, total."""
    c = quoted(salary)
    median = column_quantiles(df, [salary], [0.5]).select("q0").scalar()
    row = df.agg(F.count(c).alias("n"), mean_of(c).alias("avg"), F.min(c).cast("double").alias("min"),
                 F.max(c).cast("double").alias("max"), F.stddev_samp(c).alias("std_dev"),
                 F.sum(c).cast("double").alias("total"))
    return row.where("n > 0").withColumns({"median": median, "range": F.col("max") - F.col("min")}).select(
        *[rounded(F.col(x), 2).alias(x) for x in ("avg", "median", "min", "max", "range", "std_dev", "total")])


def salary_by_department(df: DataFrame, department: str = "department", salary: str = "salary") -> DataFrame:
    """(department, avg, median, count)."""
    known = df.where(quoted(department).isNotNull()).select(
        quoted(department).alias("department"), quoted(salary).alias("__s"))
    basic = known.groupBy("department").agg(mean_of(F.col("__s")).alias("avg"), F.count("__s").alias("count"))
    median = quantiles(known, ["department"], "__s", [0.5]).select("department", F.col("q0").alias("median"))
    return same_keys(basic, median, ["department"], "left").select(
        "department", rounded(F.col("avg"), 2).alias("avg"), rounded(F.col("median"), 2).alias("median"), "count")


def headcount(df: DataFrame, employee: str = "employee") -> DataFrame:
    """One row: total rows, distinct employees, and whether names repeat."""
    per = df.groupBy(quoted(employee).alias("e")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("e").alias("unique_employees")).select(
        "total", "unique_employees", (F.col("unique_employees") < F.col("total")).alias("has_duplicates"))


def headcount_by(df: DataFrame, dimension: str) -> DataFrame:
    """(dimension, count), most first."""
    known = df.where(quoted(dimension).isNotNull())
    return known.groupBy(quoted(dimension).alias(dimension)).agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), quoted(dimension))


def overtime_stats(df: DataFrame, overtime: str = "overtime") -> DataFrame:
    """One row: total, mean and maximum hours."""
    c = quoted(overtime)
    return df.agg(F.count(c).alias("n"), F.sum(c).alias("t"), mean_of(c).alias("a"), F.max(c).alias("m")).where(
        "n > 0").select(rounded(F.col("t"), 2).alias("total_hours"), rounded(F.col("a"), 2).alias("avg_hours"),
                        rounded(F.col("m"), 2).alias("max_hours"))


def overtime_by_employee(df: DataFrame, employee: str = "employee", overtime: str = "overtime",
                         n: int = TOP_OVERTIME) -> DataFrame:
    """(employee, total_hours) of the n employees with most hours."""
    per = df.where(quoted(employee).isNotNull()).groupBy(quoted(employee).cast("string").alias("employee")).agg(
        F.coalesce(F.sum(quoted(overtime)), F.lit(0)).alias("h"))
    return per.orderBy(F.desc("h"), "employee").limit(n).select("employee", rounded(F.col("h"), 2).alias("total_hours"))


def overtime_cost(df: DataFrame, salary: str = "salary", overtime: str = "overtime") -> DataFrame:
    """One row: mean salary / 173 x hours x 1.5. The mean salary counts with two decimals."""
    pay = rounded(mean_of(quoted(salary)), 2)
    hours = F.sum(quoted(overtime)).cast("double")
    cost = F.coalesce(pay, F.lit(0.0)) / MONTHLY_HOURS * hours * OVERTIME_RATE
    return df.agg(rounded(cost, 2).alias("estimated_cost")).where("estimated_cost is not null")


def attendance_distribution(df: DataFrame, attendance: str = "attendance", n: int = TOP_ATTENDANCE) -> DataFrame:
    """(unique_values, value, count): the n most frequent values."""
    counts = df.where(quoted(attendance).isNotNull()).groupBy(
        quoted(attendance).cast("string").alias("value")).agg(F.count("*").alias("count"))
    kinds = counts.agg(F.count("*")).scalar()
    best = counts.orderBy(F.desc("count"), "value").limit(n)
    return best.withColumn("unique_values", kinds).select("unique_values", "value", "count")


def attendance_monthly(df: DataFrame, date: str = "date", attendance: str = "attendance") -> DataFrame:
    """(month, value, count) for every month and value."""
    rows = df.where(quoted(date).isNotNull() & quoted(attendance).isNotNull())
    return rows.groupBy(F.date_trunc("month", quoted(date)).alias("month"),
                        quoted(attendance).cast("string").alias("value")).agg(F.count("*").alias("count"))


def duplicate_employees(df: DataFrame, employee: str = "employee", n: int = LISTED_DUPLICATES) -> DataFrame:
    """(name, count): the n names that occur most often, more than once."""
    counts = df.where(quoted(employee).isNotNull()).groupBy(
        quoted(employee).cast("string").alias("name")).agg(F.count("*").alias("count"))
    return counts.where(F.col("count") > 1).orderBy(F.desc("count"), "name").limit(n)


def duplicate_employee_rows(df: DataFrame, employee: str = "employee", salary: str | None = "salary",
                            department: str | None = "department", n: int = LISTED_DUPLICATES) -> DataFrame:
    """(name, salary, department): the rows behind ``duplicate_employees``, one row each, so
    that no list grows with the data."""
    names = duplicate_employees(df, employee, n).select("name")
    rows = df.select(quoted(employee).cast("string").alias("name"),
                     *[quoted(c).alias(r) for r, c in (("salary", salary), ("department", department)) if c])
    return rows.join(F.broadcast(names), "name", "left_semi")


def productivity_stats(df: DataFrame, productivity: str = "productivity") -> DataFrame:
    """One row: avg, median, min, max."""
    c = quoted(productivity)
    median = column_quantiles(df, [productivity], [0.5]).select("q0").scalar()
    row = df.agg(F.count(c).alias("n"), mean_of(c).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"))
    return row.where("n > 0").withColumn("median", median).select(
        *[rounded(F.col(x), 2).alias(x) for x in ("avg", "median", "min", "max")])


def top_bottom_performers(df: DataFrame, employee: str = "employee", productivity: str = "productivity") -> DataFrame:
    """(group, employee, score): mean score per employee, best 10 and worst 5."""
    per = df.where(quoted(employee).isNotNull()).groupBy(quoted(employee).cast("string").alias("employee")).agg(
        mean_of(quoted(productivity)).alias("s")).where("s is not null")
    best = per.orderBy(F.desc("s"), "employee").limit(BEST)
    worst = per.orderBy("s", F.desc("employee")).limit(WORST)
    shown = lambda frame, name: frame.select(F.lit(name).alias("group"), "employee", rounded(F.col("s"), 2).alias("score"))
    return shown(best, "top").unionByName(shown(worst, "bottom"))


def people(df: DataFrame, roles: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Every people result the table has the columns for."""
    found = detect_roles(df, "people", roles)
    table = df.select(*[without_nan(df, quoted(c), c).alias(r) for r, c in found.items()])
    has = set(found).issuperset
    out: dict[str, DataFrame] = {}
    if has({"salary"}):
        out["salary_stats"] = salary_stats(table)
    if has({"salary", "department"}):
        out["salary_by_department"] = salary_by_department(table)
    if has({"employee"}):
        out["headcount"] = headcount(table)
        out["duplicate_employees"] = duplicate_employees(table)
        out["duplicate_employee_rows"] = duplicate_employee_rows(
            table, salary="salary" if has({"salary"}) else None,
            department="department" if has({"department"}) else None)
    for dimension in ("department", "location"):
        if has({dimension}):
            out[f"headcount_by_{dimension}"] = headcount_by(table, dimension)
    if has({"overtime"}):
        out["overtime_stats"] = overtime_stats(table)
    if has({"overtime", "employee"}):
        out["overtime_by_employee"] = overtime_by_employee(table)
    if has({"overtime", "salary"}):
        out["overtime_cost"] = overtime_cost(table)
    if has({"attendance"}):
        out["attendance_distribution"] = attendance_distribution(table)
    if has({"attendance", "date"}):
        out["attendance_monthly"] = attendance_monthly(table)
    if has({"productivity"}):
        out["productivity_stats"] = productivity_stats(table)
    if has({"productivity", "employee"}):
        out["top_bottom_performers"] = top_bottom_performers(table)
    return out
