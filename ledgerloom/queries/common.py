"""What query modules share."""

from ..functions.amounts import MONEY
from ..plans.ledger import derived, derived_oracle, dimension, ledger, oracle
from ..plans.registry import query
from ..storage import table

#: Dates that queries filter by.
FROM, TO = "1998-01-01", "1999-12-31"

__all__ = ["FROM", "MONEY", "TO", "derived", "derived_oracle", "dimension", "ledger", "oracle", "query", "table"]
