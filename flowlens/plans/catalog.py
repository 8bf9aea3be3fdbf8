"""Imports all plan modules (registration side effect)."""

from flowlens.plans import q_labels  # noqa: F401
from flowlens.plans import q_clean  # noqa: F401
from flowlens.plans import q_profile  # noqa: F401
from flowlens.plans import q_sample  # noqa: F401
from flowlens.plans import q_verdict  # noqa: F401
from flowlens.plans import q_evaluate  # noqa: F401
from flowlens.plans import q_stream  # noqa: F401
from flowlens.plans import q_ml  # noqa: F401
