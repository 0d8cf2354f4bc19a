"""Model jobs and end-to-end jobs, composed of the operators."""
