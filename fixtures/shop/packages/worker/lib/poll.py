def poll():
    return 1
