"""Sources of JSON text, and the workspace that they are staged in."""
