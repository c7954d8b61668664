"""Multi-criteria decision analytics on panels, written as Spark DataFrame jobs."""

from panelwise.panel import Hierarchy, Panel

__all__ = ["Hierarchy", "Panel"]
