"""The derived tables of one run: each is written once, when first asked for, and read by all that is made from it."""
from revisio.operators import appointments, attempts, field_tables, fields, readings, retries, sources
from revisio.shared import written
from revisio.sql import frame


class Derived:
    """rec, ast and rdb are records, assistance and readability rows; the rest follows from them.

    t.name is the written table; t.made(name) is its plan over the tables that it needs, for who reads it once. Wide tables that a
    step reads once are not written for it: t.lean(name) is their plan, of which only the columns that the step takes are computed."""

    #: Plans that are joined on the spot rather than written.
    PLAIN = ("atx", "fbk")
    #: Wide plans that a single reader has computed for its columns alone.
    LEAN = ("rec", "att", "stu", "stx", "ctx")

    def __init__(self, spark, base, cutoff, zone=retries.ZONE):
        self.spark, self.base, self.cutoff, self.zone = spark, base, cutoff, zone

    def made(self, name):
        t = self
        plans = {"att": lambda: attempts.attempts(t.lean("rec")), "stu": lambda: attempts.studies(t.lean("att")), "aut": lambda: attempts.authors(t.att), "atx": lambda: attempts.sourced(t.lean("att"), t.lean("rec").hint("merge")), "stx": lambda: attempts.snapshot(t.lean("stu").hint("merge"), t.lean("rec")),
                 "fbk": lambda: attempts.feedback(t.lean("rec")), "app": lambda: appointments.appointments(t.rec), "gen": lambda: sources.generations(t.lean("rec")), "trn": lambda: sources.transitions(t.gen), "pth": lambda: sources.pathways(t.lean("rec").hint("merge"), t.gen, t.large("trn")),
                 "ctx": lambda: retries.context(t.lean("att"), t.large("gen"), t.large("trn"), t.large("fbk"), t.cutoff, t.zone), "fin": lambda: t.lean("rec").where("ATTEMPT_RESULT = 'COMPLETE'").select("ID", "STUDY_NUM", "ATTEMPT_TYPE", "ATTEMPT_RESULT", "END_TIME"), "fld": lambda: frame(fields.COMPLETED, rec=t.fin, ast=t.large("ast")), "prs": lambda: readings.pairs(t.rdb, t.fld), "sel": lambda: frame(field_tables.SELECTIONS, fld=t.fld)}
        return (self.base | plans)[name]()

    def large(self, name):
        """t.name for a join with another table that grows: sorted, not broadcast. Spark takes a few columns of a written table, compressed, for much less than they are."""
        return getattr(self, name).hint("merge")

    def lean(self, name):
        """t.name where it is written already, or else, of a wide table, its plan."""
        return self.made(name) if name in self.LEAN and name not in vars(self) else getattr(self, name)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        made = self.made(name)
        table = made if name in self.PLAIN else written(made)
        setattr(self, name, table)
        return table
