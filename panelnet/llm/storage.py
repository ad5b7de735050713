"""Tables in the shared folder; see panelnet.storage."""

from panelnet.storage import dropped, saved, shared_folder

__all__ = ["dropped", "saved", "shared_folder"]
