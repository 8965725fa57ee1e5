"""The engine over HTTP, with background jobs, a scheduler and a command line."""

from .jobs import Jobs, Scheduler
from .server import Service, serve

__all__ = ["Jobs", "Scheduler", "Service", "serve"]
