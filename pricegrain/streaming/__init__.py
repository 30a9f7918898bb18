"""Streams of price events: daily lows with late data, and keyed state as it arrives."""
