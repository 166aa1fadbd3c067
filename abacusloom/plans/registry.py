"""All registered queries and the SQL of those that SQL can express."""

from . import accounts, composition, content, firms, learner, ledger, planning, reporting, statistics
from .learner import calibration

_PARTS = (learner, ledger, statistics, composition, planning, content, accounts, firms, reporting)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in _PARTS for k, f in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "calibration"]
