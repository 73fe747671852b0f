"""Query plans: the chain from events to alerts and the analyst queries."""
