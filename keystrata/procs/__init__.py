"""Packages of named procedures: plain functions of a session, installed with Engine.install."""
