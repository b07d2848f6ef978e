from kinweave.plans.pipeline import main

main()
