"""Streaming. The engine's operators answer requests on stored tables and need no streaming state; `arrivals` is an
extension for loading files as they arrive, not part of the query surface."""
