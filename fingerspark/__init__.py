"""fingerspark: behavioural analytics on container runtime telemetry, as Spark jobs."""
