"""Where logs come from and go to: stores of events, snapshots and reminders, frame files and sockets, record codecs."""
