"""Query plans over the driver tables; importing this package fills the registry."""

from . import scoring, features, evaluate, fairness, ops, landing, policy, retrieval  # noqa: F401,I001
from . import privacy_audit, decision, model  # noqa: F401
from . import streaming, extras, evidence  # noqa: F401  (reuse oracles registered above)
from .catalog import ORACLES, QUERIES  # noqa: F401
from .types import typed  # noqa: E402

ORACLES.update({name: typed(name, sql) for name, sql in ORACLES.items()})
