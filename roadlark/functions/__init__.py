"""Column builders: geometry, kinematics and scores. All of them are native expressions."""
