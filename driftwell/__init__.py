"""Stream health, staged rollouts and companion social analytics as Spark DataFrame operations."""
