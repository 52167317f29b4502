"""All queries of the engine's own operators and the SQL they must agree with."""

from __future__ import annotations

from guardwalk.plans import derived, programs, relational, scalar, structure, walks, witnesses

QUERIES = {**scalar.QUERIES, **relational.QUERIES, **programs.QUERIES, **walks.QUERIES, **structure.QUERIES}
ORACLES = {**scalar.ORACLES, **relational.ORACLES, **programs.ORACLES, **walks.ORACLES, **structure.ORACLES}
