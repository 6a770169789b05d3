"""The catalog's queries; importing this package registers them."""

from tomewright.plans import registry  # noqa: F401
from tomewright.plans import catalog, library  # noqa: F401
