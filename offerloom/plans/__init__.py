"""Views of the driver's tables and the registered queries."""

from . import analytics, catalogue, events, stored_offers

__all__ = ["analytics", "catalogue", "events", "stored_offers"]
