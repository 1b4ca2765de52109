"""Dimension tables of the plant, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, class, base, sigma, cycle, mttf, mttr of each machine, in index order.
MACHINES = (
    ("A0", "feed", 50.0, 1.0, 5, 2000, 15),
    ("A1", "form", 60.0, 1.2, 5, 1500, 12),
    ("A2", "process", 70.0, 1.5, 5, 800, 20),
    ("A7", "process", 70.0, 1.5, 5, 800, 20),
    ("A8", "finish", 55.0, 1.1, 5, 1200, 10),
    ("A9", "inspect-tail", 48.0, 1.4, 5, 1500, 8),
    ("B0", "feed", 50.0, 1.0, 5, 2000, 15),
    ("B1", "form", 60.0, 1.2, 5, 1500, 12),
    ("B2", "process", 70.0, 1.5, 5, 800, 20),
    ("B7P", "process", 70.0, 1.5, 5, 800, 20),
    ("B7S", "process", 70.0, 1.5, 6, 800, 20),
    ("B8", "finish", 55.0, 1.1, 5, 1200, 10),
    ("B9", "inspect-tail", 48.0, 1.4, 5, 1500, 8),
    ("C0", "feed", 50.0, 1.0, 5, 2000, 15),
    ("C1", "form", 60.0, 1.2, 5, 1500, 12),
    ("C2", "process", 70.0, 1.5, 5, 800, 20),
    ("C6", "process", 70.0, 1.5, 5, 800, 20),
    ("C7", "inspect-tail", 48.0, 1.4, 5, 1500, 8),
    ("PKG0", "assembly-kit", 65.0, 1.3, 5, 1000, 12),
    ("PKG1", "finish", 55.0, 1.1, 10, 1200, 10),
    ("PKG2", "finish", 55.0, 1.1, 10, 1200, 10),
    ("ASM0", "assembly-kit", 65.0, 1.3, 5, 1000, 12),
    ("ASM1", "assembly-join", 66.0, 1.3, 5, 1000, 12),
    ("INSP0", "test", 45.0, 2.0, 2, 1200, 10),
    ("ASM2", "test", 45.0, 2.0, 5, 1200, 10),
    ("RWK0", "rework", 62.0, 1.6, 8, 900, 18),
)
# Rated amps by class, load factor by name prefix.
AMPS = (("feed", 8.0), ("form", 10.0), ("process", 15.0), ("finish", 12.0), ("inspect-tail", 5.0), ("assembly-kit", 9.0), ("assembly-join", 9.5), ("test", 4.0), ("rework", 3.5))
LOADS = (("A", 1.0), ("B", 1.0), ("C", 0.7), ("ASM", 0.5), ("PKG", 0.5), ("INSP", 0.5), ("RWK", 0.3))
# Buffers and capacities, in order.
BUFFERS = (
    ("A01", 20), ("A12", 20), ("A27", 25), ("A78", 15), ("A89", 15), ("B01", 20), ("B12", 20), ("B2B7P", 25), ("B2B7S", 25),
    ("B7PB8", 25), ("B7SB8", 25), ("B89", 15), ("C01", 20), ("C12", 20), ("C26", 25), ("C67", 15), ("ASM01", 25), ("INSP01", 25),
    ("INSP02", 25), ("GA9", 15), ("GB9", 15), ("C7PKG", 15), ("PKG01", 15), ("PKG02", 15), ("RWK_RET", 10), ("SBUF", 30),
)
# The flow edges, logical set.
EDGES = (
    ("A0", "A1"), ("A1", "A2"), ("A2", "A7"), ("A7", "A8"), ("A8", "A9"), ("A9", "ASM0"),
    ("B0", "B1"), ("B1", "B2"), ("B2", "B7P"), ("B2", "B7S"), ("B7P", "B8"), ("B7S", "B8"), ("B8", "B9"), ("B9", "ASM0"),
    ("C0", "C1"), ("C1", "C2"), ("C2", "C6"), ("C6", "C7"), ("C7", "PKG0"), ("C7", "ASM0"), ("PKG0", "PKG1"), ("PKG0", "PKG2"),
    ("ASM0", "ASM1"), ("ASM1", "INSP0"), ("INSP0", "ASM2"), ("ASM2", "RWK0"), ("RWK0", "C0"),
)
#: Parts physically return from rework to assembly; all other edges are the same.
PHYSICAL_EDGES = tuple(("RWK0", "ASM0") if e == ("RWK0", "C0") else e for e in EDGES)
# Constants of an episode.
T, CAL_WIN, WARMUP, SYMPTOM_TAIL = 300, 120, 15, 8
# Event name and family.
FAMILIES = (
    ("view", "flow"), ("click", "flow"), ("purchase", "output"), ("signup", "supply"), ("error", "failure"),
)
# Fault classes.
CLASSES = ("spike", "drift", "bias", "delay", "loss", "breakdown", "quality")

MACHINE_DDL = "machine string, class string, base double, sigma double, cycle int, mttf int, mttr int"


def machines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(MACHINES)], f"idx int, {MACHINE_DDL}")


def edges(spark: SparkSession, physical: bool = False) -> DataFrame:
    return spark.createDataFrame(PHYSICAL_EDGES if physical else EDGES, "src string, dst string")


def buffers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *b) for k, b in enumerate(BUFFERS)], "ord int, buffer string, cap int")


def sql_values(rows, names: str) -> str:
    """``(VALUES ...) AS t(names)`` for the SQL side."""
    cell = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"
