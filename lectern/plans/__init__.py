"""Registered queries; importing the modules registers them."""

from . import text  # noqa: F401
from . import voices  # noqa: F401
from . import markup  # noqa: F401
from . import signal  # noqa: F401
from . import jobs  # noqa: F401
