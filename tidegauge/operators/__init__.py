"""Operators over keyed daily series; every order-dependent one takes the series key and the order."""
